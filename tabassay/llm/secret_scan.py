"""Secrets in texts: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick pass over the lower-cased text finds the keywords that every
keyword-led secret begins with. Patterns are tried at those places only. Tokens with
an embedded checksum count once the checksum holds. Runs of hex digits have no
keyword and take one linear pass.

Defined results: a null or empty text has no spans; positions are code points, end
exclusive; ids repeat as often as they do in the table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.llm.tables import small_batches

# Kinds in their order, keywords, patterns and least sizes.
KINDS = ["assign", "access", "hex", "github", "npm"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED_PREFIXES = {
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
CHECKED_BODY = re.compile(r"[0-9A-Za-z]{36}(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

SPANS = "array<struct<kind:string,start:int,end:int>>"
_LOWER = {code: code + 32 for code in range(65, 91)}


@lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for prefix, kind in CHECKED_PREFIXES.items():
        found.add_word(prefix, (kind, 4))
    found.make_automaton()
    return found


def checksum_holds(body: str) -> bool:
    """Whether the last 6 of 36 characters are the CRC-32 of the first 30 in base 62."""
    rest, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits == body[30:]


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then by the order of ``KINDS``."""
    if not text:
        return []
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer
        lower = text.translate(_LOWER)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _keywords().iter(lower))
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    done = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if match := ASSIGN.match(text, start):
                done[kind] = match.end()
                if match.end() - match.start(1) >= ASSIGN_LEAST:
                    spans.append((kind, *match.span()))
        elif kind == "access":
            if match := ACCESS.match(text, start):
                done[kind] = match.end()
                if match.end() - start >= ACCESS_LEAST:
                    spans.append((kind, *match.span()))
        elif CHECKED_PREFIXES.get(text[start : start + 4]) == kind:
            match = CHECKED_BODY.match(text, start + 4)
            if match and checksum_holds(match.group()):
                done[kind] = match.end()
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str | None, mask: str = "[secret]") -> str | None:
    """The text with every secret replaced; overlapping spans are replaced once."""
    spans = spans_of(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _span_lists(texts: pd.Series) -> pd.DataFrame:
    found = [spans_of(t) for t in texts]
    return pd.DataFrame(
        {
            "kinds": [[s[0] for s in one] for one in found],
            "starts": [[s[1] for s in one] for one in found],
            "ends": [[s[2] for s in one] for one in found],
        }
    )


def _masked(texts: pd.Series) -> pd.Series:
    return texts.map(masked, na_action="ignore")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``, an array of (kind, start, end), of every row."""
    small_batches(docs.sparkSession)
    lists = F.pandas_udf(_span_lists, "kinds array<string>, starts array<int>, ends array<int>")
    rows = docs.select(F.col(id_col), lists(text_col).alias("found"))
    zipped = F.arrays_zip("found.kinds", "found.starts", "found.ends")
    return rows.select(id_col, zipped.cast(SPANS).alias("spans"))


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by a mark."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, F.pandas_udf(_masked, "string")(text_col))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )
