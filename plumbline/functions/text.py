"""Text expressions: whitespace cleaning, tokens, sentences, ids, file kinds."""
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white-space characters Unicode-aware regexes match, and the line ends of text splitting.
WHITESPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
                    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WHITESPACE = f"[{WHITESPACE_CHARS}]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"
TOKEN = "[a-z0-9]+(?:\\.[a-z0-9]+)*"
SENTENCE_GAP = "(?<=[.!?])\\s+"
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "webp")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda is inlined there by the optimizer and would be computed again for every element;
    binding it as a lambda variable keeps it to one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def clean_text(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed.  Other white space is made spaces first: a pattern that begins with
    one plain character passes over a text faster than one of character classes."""
    spaces = F.translate(c, WHITESPACE_CHARS, " " * len(WHITESPACE_CHARS))
    return F.trim(F.regexp_replace(spaces, "  +", " "))


def tokenize(c: Column) -> Column:
    """Lower-case ASCII alphanumeric tokens; dotted forms such as ``3.5`` stay whole."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def split_sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(c, SENTENCE_GAP)


def split_lines(c: Column) -> Column:
    """Stripped, non-blank lines."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda line: line != "")


@F.pandas_udf(T.StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normalize_nfkd(c: Column) -> Column:
    """Unicode NFKD, then white-space collapse.  Spark has no built-in for NFKD, so that half is an Arrow UDF;
    pure ASCII text is its own NFKD form and skips the Python round trip."""
    return clean_text(F.when(c.rlike("^\\p{ASCII}*$"), c).otherwise(_nfkd(c)))


def text_chunk_id(doc_id: Column, section_id: Column, ordinal: Column) -> Column:
    return F.concat(doc_id, F.lit("_s"), section_id.cast("string"), F.lit("_t"), ordinal.cast("string"))


def table_chunk_id(doc_id: Column, section_id: Column, table_id: Column, group: Column) -> Column:
    return F.concat(doc_id, F.lit("_s"), section_id.cast("string"), F.lit("_"), table_id, F.lit("_r"),
                    group.cast("string"))


def image_chunk_id(doc_id: Column, section_id: Column, image_id: Column) -> Column:
    return F.concat(doc_id, F.lit("_s"), section_id.cast("string"), F.lit("_"), image_id)


def page_image_chunk_id(file_id: Column, page: Column, ordinal: Column) -> Column:
    return F.concat(file_id, F.lit("_p"), page.cast("string"), F.lit("_img"), ordinal.cast("string"))


def file_kind(name: Column) -> Column:
    """Display kind of a file name: PDF, CSV, IMG, TXT, or ``?`` when there is no name."""
    extension = F.lower(F.substring_index(name, ".", -1))
    return (F.when(name.isNull() | (name == ""), "?").when(extension == "pdf", "PDF").when(extension == "csv", "CSV")
            .when(extension.isin(*IMAGE_EXTENSIONS), "IMG").otherwise("TXT"))


def cache_key(org_id: Column, query: Column) -> Column:
    return F.md5(F.concat_ws(":", org_id, query).cast("binary"))


def session_title(first_message: Column, max_chars: int = 30) -> Column:
    head = F.substring(first_message, 1, max_chars)
    return F.when(F.length(first_message) > max_chars, F.concat(head, F.lit("..."))).otherwise(head)


def decode_data_uri(c: Column) -> Column:
    """Bytes of a base64 string; a ``data:`` prefix is dropped up to the first comma.  Undecodable text gives null."""
    body = F.when(c.startswith("data:"), F.regexp_replace(c, "^[^,]*,", "")).otherwise(c)
    return F.try_to_binary(body, F.lit("base64"))
