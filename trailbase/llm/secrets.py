"""Secret scans: a keyword automaton first, anchored patterns near its hits, checksums last.

An Aho-Corasick automaton over all keywords passes once over each text.  Only
where it hits is a kind's pattern tried, anchored at the hit.  Runs of
hexadecimal digits have no keyword: a run of 32 or more covers two neighbouring
multiples of 16, so every 16th byte is looked at and runs are measured only
around such pairs.  Candidates of kinds that carry a checksum count only if it
holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .workspace import documents

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
KINDS = ("assign", "access", "hex", "checked")
#: Keywords and the kind that each may begin. Those of assign are matched in lower case.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign", "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked"}
#: Fixed value: digits of the checksum's base 62, in order.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_automaton: list = []


def automaton():
    if not _automaton:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def checksum_holds(body: bytes, check: bytes) -> bool:
    """Whether check is the CRC-32 of body in six base-62 digits."""
    value, digits = zlib.crc32(body), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0").encode() == check


def hex_runs(data: np.ndarray, at: np.ndarray, least: int = 32) -> list[tuple[int, int, int]]:
    """(document, start, end) of maximal runs of at least ``least`` hexadecimal digits, in bytes of each document."""
    step = least // 2
    probe = HEX[data[::step]]
    near = np.flatnonzero(probe[1:] & probe[:-1]) if len(probe) > 1 else np.zeros(0, np.int64)
    out, seen = [], -1
    for low in (near * step).tolist():
        if low < seen:
            continue
        doc = int(np.searchsorted(at, low, "right")) - 1
        first, last = int(at[doc]), int(at[doc + 1])
        start, end = low, low
        while start > first and HEX[data[start - 1]]:
            start -= 1
        size = 64
        while end < last:
            stop = np.flatnonzero(~HEX[data[end : min(last, end + size)]])
            if len(stop):
                end += int(stop[0])
                break
            end, size = min(last, end + size), size * 2
        seen = end
        if end - start >= least:
            out.append((doc, start - first, end - first))
    return out


def keyword_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, from patterns tried at the automaton's hits alone."""
    hits = [(end + 1 - size, kind) for end, (size, kind) in automaton().iter(text.lower().decode("latin-1"))]
    if not hits:
        return []
    out, after = [], dict.fromkeys(KINDS, 0)
    for start, kind in sorted(hits):
        if start < after[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, start)):
            after[kind] = m.end()
            if len(m[1]) >= 8:
                out.append((start, m.end(), kind))
        elif kind == "access" and (m := ACCESS.match(text, start)):
            after[kind] = m.end()
            if m.end() - start >= 16:
                out.append((start, m.end(), kind))
        elif kind == "checked" and (m := CHECKED.match(text, start)) and checksum_holds(m[1], m[2]):
            after[kind] = m.end()
            out.append((start, m.end(), kind))
    return out


def find(data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """Each document's spans (start, end, kind) in code points, by start and then kind."""
    found: list[list] = []
    whole = data.tobytes()
    for low, high in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        found.append(keyword_spans(whole[low:high]))
    for doc, start, end in hex_runs(data, at):
        found[doc].append((start, end, "hex"))
    for doc, spans in enumerate(found):
        if spans:
            spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            points = np.r_[0, np.cumsum((data[at[doc] : at[doc + 1]] & 0xC0) != 0x80)]
            found[doc] = [(int(points[a]), int(points[b]), k) for a, b, k in spans]
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, end, kind; code points, end exclusive) of whole texts, one row for each row.

    No exchange.  Null, empty and clean texts have an empty array; rows with a
    null doc_id and repeated rows are scanned like any other; further columns
    are left out.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for part, data, at in flat.pieces(batches, 4 << 20):
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in find(data, at)]
            yield pa.record_batch([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def report(docs: DataFrame) -> DataFrame:
    """The scan as counts and digests: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked.

    One row for each row of docs, as in ``scan``: null, empty and clean texts
    have no spans and the digest of the empty text; rows with a null doc_id and
    repeated rows are reported each; spans with one start go by kind; very long
    texts are scanned whole; an empty table gives an empty result.
    """
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "checked")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("checked"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with every secret in text replaced by ``mark``; n_chars, if there, follows the text.

    Overlapping spans are replaced as one.  Null, empty and clean texts stay as
    they are; rows with a null doc_id and repeated rows are treated like others;
    columns of any name stay; an empty table gives an empty result.
    """
    fields = docs.columns
    place = fields.index("text")

    def run(batches):
        for part, data, at in flat.pieces(batches, 4 << 20):
            texts, spans = part.column(place), find(data, at)
            if any(spans):
                new = texts.to_pylist()
                for i, own in enumerate(spans):
                    if own:
                        out, seen = [], 0
                        for a, b, _ in own:
                            if a >= seen:
                                out += [new[i][seen:a], mark]
                            seen = max(seen, b)
                        new[i] = "".join([*out, new[i][seen:]])
                texts = pa.array(new, texts.type)
            columns = list(part.columns)
            columns[place] = texts
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in fields else out
