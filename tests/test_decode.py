"""Files that a decoder can't read, each with its reason."""

from docloom.sources import files


def test_encrypted_and_damaged_files(spark):
    def pages_of(content: bytes) -> list[str]:
        if content.startswith(b"locked"):
            raise files.Encrypted("password")
        return content.decode().split("|")

    rows = spark.createDataFrame([("a", bytearray(b"x|y")), ("b", bytearray(b"locked")), ("c", bytearray(b"\xff"))], "path string, content binary")
    got = sorted((r.path, r.text or "", (r.error or "").split(":")[0]) for r in files.decode(rows, pages_of).collect())
    assert got == [("a", "x", ""), ("a", "y", ""), ("b", "", "encrypted"), ("c", "", "UnicodeDecodeError")]
