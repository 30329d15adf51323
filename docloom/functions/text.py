"""Text functions over Columns. Nulls stay null unless a function says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases that go straight to general chat.
GREETINGS = ["hi", "hello", "hey", "good morning", "good afternoon", "good evening", "thanks", "thank you", "bye", "goodbye", "see you", "how are you", "how are you?", "who are you", "who are you?", "what can you do", "what can you do?"]
# Words in an error text, reason, suggestion; the first row with a word contained wins.
ERROR_TEXTS = [
    (["connection", "timeout", "unreachable", "refused"], "Service temporarily unavailable.", "Check your network connection or try again in a moment."),
    (["quota", "rate limit", "rate_limit", "429"], "API quota exceeded.", "Please wait a moment and try again."),
    (["model", "unavailable", "not found", "does not exist"], "Selected language model is unavailable.", "Choose a different model from the sidebar."),
    (["elasticsearch", "elastic"], "Keyword search service could not be reached.", "The search backend may be temporarily down."),
    (["qdrant"], "Vector database could not be reached.", "The vector search backend may be temporarily down."),
    (["api key", "api_key", "authentication", "unauthorized", "401", "403"], "Authentication error.", "Check your API key configuration."),
    (["embedding"], "Embedding model encountered an error.", "The AI embedding service may be temporarily unavailable."),
]
ERROR_TITLE = "Unable to generate a response."
ERROR_OTHER = ("An unexpected error occurred.", "Please try again or choose a different query.")


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(x: Column) -> Column:
    """Unicode NFC. Pure ASCII rows never leave the JVM's value (the branch keeps them as they are)."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_nfc(x))


def unix_newlines(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_controls(x: Column) -> Column:
    """Deletes control characters but tab and newline; neighbours are glued."""
    return F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def one_space(x: Column) -> Column:
    """Unicode whitespace runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def clean(x: Column, normalise: bool = True) -> Column:
    """NFC, newlines, controls, spaces, in this order."""
    return one_space(drop_controls(unix_newlines(nfc(x) if normalise else x)))


def title_case(x: Column) -> Column:
    """A capital after every character that is no letter: O'NEIL becomes O'Neil."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def n_tokens(x: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def normal_query(x: Column) -> Column:
    return one_space(F.lower(x))


def strip_ids(x: Column) -> Column:
    """Removes ``document id:`` lines from a context (an empty one takes the next line along) and trims."""
    return F.regexp_replace(F.regexp_replace(x, r"(?imdU)^\s*document id:\s*.*$\n?", ""), r"(?U)^\s+|\s+$", "")


def strip_thinking(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""), r"(?U)^\s+|\s+$", "")


def chunk_id(document: Column, version: Column, start: Column, end: Column) -> Column:
    """document:first 16 hex digits of sha256(document NUL version NUL start NUL end)."""
    whole = F.concat_ws("\0", document, version, start.cast("string"), end.cast("string"))
    return F.concat(document, F.lit(":"), F.substr(F.sha2(whole, 256), F.lit(1), F.lit(16)))


def preview(x: Column, size: int = 250) -> Column:
    return F.substr(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit(1), F.lit(size))


def html_escape(x: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(name))
    return x


def page_label(start: Column, end: Column, card: bool = False) -> Column:
    """``n`` or ``a-b``; on a card ``Page n`` or ``Pages a–b``."""
    one, two, dash = ("Page ", "Pages ", "–") if card else ("", "", "-")
    return F.when(start == end, F.concat(F.lit(one), start.cast("string"))).otherwise(F.concat(F.lit(two), start.cast("string"), F.lit(dash), end.cast("string")))


def score_label(method: Column, score: Column) -> Column:
    """Score of a retrieved chunk as text, by method: share of 100, BM25, hybrid, other."""
    return (
        F.when(method == "semantic", F.concat(F.format_string("%.1f", score * 100), F.lit("%")))
        .when(method == "keyword", F.concat(F.lit("BM25 "), F.format_string("%.2f", score)))
        .when(method == "hybrid", F.concat(F.lit("Hybrid "), F.format_string("%.4f", score)))
        .otherwise(F.format_string("%.4f", score))
    )


def elapsed(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; hours go beyond two digits."""
    s = F.floor(seconds).cast("long")
    pad = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat_ws(":", pad(F.floor(s / 3600)), pad(F.floor(s / 60) % 60), pad(s % 60))


def error_message(kind: Column, message: Column) -> Column:
    """struct(title, reason, suggestion) of an error."""
    text = F.lower(F.concat_ws(" ", kind, message))
    out = None
    for words, reason, suggestion in ERROR_TEXTS:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))
        row = F.struct(F.lit(ERROR_TITLE).alias("title"), F.lit(reason).alias("reason"), F.lit(suggestion).alias("suggestion"))
        out = F.when(hit, row) if out is None else out.when(hit, row)
    return out.otherwise(F.struct(F.lit(ERROR_TITLE).alias("title"), F.lit(ERROR_OTHER[0]).alias("reason"), F.lit(ERROR_OTHER[1]).alias("suggestion")))


def new_id() -> Column:
    """A random UUID, another in every row."""
    return F.uuid()


def now_utc() -> Column:
    """The query's time in UTC as ISO text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def point_id(chunk: Column) -> Column:
    """uuid5 of the URL namespace and the chunk id."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.substr(F.sha1(F.concat(namespace, F.encode(chunk, "UTF-8"))), F.lit(1), F.lit(32))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    variant = F.lower(F.hex(F.conv(part(17, 2), 16, 10).cast("long").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))
