"""Column functions for cleaning, labels, identities and display. Lengths count code points; white space is Unicode's."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A statute's article that has been struck out.
DELETED = r"(?U)^[（(]\s*刪除\s*[）)]$"
#: The name space for ids of text units (RFC 9562, URLs).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed form. Spark has no function for it; texts of ASCII alone, which don't change, give the Python step nothing to
    do but pass a null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(_nfc(F.when(~ascii_only, text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column, *, compose: bool = True) -> Column:
    """Composed, line ends as \\n, no control characters, no trailing blanks, at most one empty line in a row, stripped."""
    t = nfc(text) if compose else text
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F﻿]", "")
    t = F.regexp_replace(t, r"(?md)[ \t　]+$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def normalize_label(label: Column) -> Column:
    return F.regexp_replace(strip(label), r"(?U)\s+", " ")


def normalize_name(name: Column) -> Column:
    """Without one remark in brackets at the end."""
    return strip(F.regexp_replace(strip(name), r"(?U)\s*[（(][^（()）]*[）)]$", ""))


def header(title: Column, chapter: Column, article: Column | None = None) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", title, blank(chapter), *([] if article is None else [blank(article)]))


def article_label(articles: Column) -> Column:
    first, last = F.try_element_at(articles, F.lit(1)), F.try_element_at(articles, F.lit(-1))
    return F.when(F.size(articles) < 1, "").when(F.size(articles) == 1, first).otherwise(F.concat(first, F.lit("～"), last))


def citation(title: Column, label: Column) -> Column:
    return strip(F.concat_ws(" ", title, label))


def public_source_path(path: Column) -> Column:
    """A path that tells nothing of the machine: relative as it is; of an absolute one, or one that climbs, the last part."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    private = slashed.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)")
    return F.when(private, F.substring_index(F.regexp_replace(slashed, "/+$", ""), "/", -1)).otherwise(path)


def chunk_id(doc_id: Column, kind: str, seq: Column) -> Column:
    return F.format_string(f"%s#{kind}%04d", doc_id, seq)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A version-5 UUID: SHA-1 of name space and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def embedding_key(model: str, revision: str, text: Column) -> Column:
    return F.sha2(F.encode(F.concat(F.lit(f"{model}@{revision}\n"), text), "UTF-8"), 256)


def canonical_sha256(text: Column) -> Column:
    """Of a text with line ends as \\n."""
    return F.sha2(F.encode(F.regexp_replace(text, r"\r\n?", "\n"), "UTF-8"), 256)


def canonical_json_sha256(**fields: Column) -> Column:
    """Of the compact JSON object of these fields, keys sorted; a null is an empty string. Control characters in values are
    written as JSON allows, in upper-case hexadecimal."""
    return F.sha2(F.encode(F.to_json(F.struct(*(F.coalesce(fields[k], F.lit("")).alias(k) if k != "articles" else fields[k].alias(k) for k in sorted(fields)))), "UTF-8"), 256)


def iso_date(day: Column) -> Column:
    """YYYYMMDD as YYYY-MM-DD, anything else as it is."""
    return F.regexp_replace(day, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """The URL if it is https and its host is one of these, else an empty string."""
    fits = F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lit(False)) & F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))
    return F.when(fits, url).otherwise("")


def without_thinking(text: Column) -> Column:
    """A model's answer without <think> blocks: whole ones, then from an unclosed one on, then up to a stray end."""
    whole = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    cut = F.regexp_replace(whole, r"(?s)<think>.*$", "")
    return F.regexp_replace(F.regexp_replace(cut, r"(?s)^.*?</think>", ""), r"(?U)^\s+", "")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


# Function words that a lexical index of statutes leaves out.
STOP_WORDS = "的 之 於 及 或 與 等 為 而 且 亦 並 但 即 者 也 得 應 予 所 其 此 該 依 按 使 令".split()


def han_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and overlapping pairs of Han characters (a single one stays): a segmentation without a
    dictionary. Function words are left out."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]+|[A-Za-z0-9]+"), F.lit(0))
    pairs = lambda r: F.when(r.rlike("^[A-Za-z0-9]") | (F.char_length(r) < 2), F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, 2))
    )
    return F.filter(F.flatten(F.transform(runs, pairs)), lambda t: ~t.isin(STOP_WORDS))
