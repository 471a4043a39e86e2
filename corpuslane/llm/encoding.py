"""Text that was decoded with a wrong character encoding: detection and round-trip repair.

A token is re-encoded under a legacy encoding it may have been read with and strictly decoded as the encoding that was
meant, again and again while a garbling cost drops. The cost of a token is the negative log-likelihood of its
non-ASCII characters between their neighbours, under trigram counts over all values of the table; the counts are kept
in a hashed table of fixed size, so that the model that is broadcast does not grow with the data.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]+")
LATIN, CYRILLIC = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]"), re.compile("[Ѐ-ӿ]")
LOST = "�"
#: Encodings in which bytes may have been read, and which a single-byte text may have been meant in.
READ_AS, MEANT = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866"), ("cp1252", "cp1251", "mac_roman", "koi8_r")
#: Drop of cost (in nats) from which a repair is accepted: UTF-8 sequences hardly arise by chance, single bytes do.
LEAST_DROP_UTF8, LEAST_DROP_BYTE = 1.0, 2.3
MOST_LAYERS = 4


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes that a Windows page leaves open stand for themselves, as lenient readers have it."""
    return {bytes([b]).decode(encoding, "replace").replace(LOST, chr(b)): b for b in range(128, 256)}


_BYTES = {e: _bytes_of(e) for e in READ_AS}
_CHARS = {e: {b: c for c, b in _bytes_of(e).items()} for e in MEANT}
#: Characters besides letters that a repair by single bytes may bring forth.
_MARKS = set("“”‘’„‚–—…°«»€§¡¿ºª")
_MAPS = {(r, m): {c: x for c, b in _BYTES[r].items() if (x := _CHARS[m][b]).isalpha() or x in _MARKS} for r in READ_AS for m in MEANT if r != m and {r, m} != {"cp1252", "latin-1"}}


def _from_utf8(token: str, to_byte: dict[str, int]) -> str:
    """token with every run of characters that are the bytes of a UTF-8 character replaced by that character."""
    out, k, n = [], 0, len(token)
    while k < n:
        lead = to_byte.get(token[k], 0)
        more = 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0
        if more and k + more < n:
            try:
                out.append(bytes([lead, *(to_byte.get(c, 0) for c in token[k + 1 : k + 1 + more])]).decode("utf-8"))
                k += 1 + more
                continue
            except UnicodeDecodeError:
                pass
        out.append(token[k])
        k += 1
    return "".join(out)


def _mixes_scripts(token: str) -> bool:
    return bool(LATIN.search(token) and CYRILLIC.search(token))


def _slots(token: str) -> list[int]:
    """Table places of the trigrams around the non-ASCII characters of a token; ASCII marks count as blanks there."""
    padded = re.sub(r"[0-9]", "0", re.sub(r"[^\x80-\U0010ffffA-Za-z0-9]", " ", f" {token} "))
    return [xxhash.xxh3_64_intdigest(padded[k - 1 : k + 2]) & ((1 << BITS) - 1) for k in range(1, len(padded) - 1) if padded[k] > "\x7f"]


class Repairer:
    """Repairs of tokens under a table of trigram counts."""

    def __init__(self, counts: dict[int, int]):
        total = math.log(sum(counts.values()) + 0.5 * 2**BITS)
        self.costs = np.full(1 << BITS, total - math.log(0.5))
        for slot, n in counts.items():
            self.costs[slot] = total - math.log(n + 0.5)
        self.done: dict[tuple, tuple] = {}

    def cost(self, token: str) -> tuple[float, float]:
        """The sum over the non-ASCII characters, and the highest of them."""
        each = [float(self.costs[s]) for s in _slots(token)]
        return sum(each), max(each, default=0.0)

    def _better(self, token: str, cost: tuple[float, float], options: dict[str, tuple]) -> tuple | None:
        """The option of least cost among those that lower the sum by enough.

        Single bytes may not mix Latin and Cyrillic in a token, and nothing but a UTF-8 sequence for a usual letter or
        mark may raise the highest cost.
        """
        scored, mixed = [], _mixes_scripts(token)
        for s, (least, pair) in options.items():
            c = self.cost(s)
            usual = pair is None and all(x in _MARKS or "\xa0" <= x < "\u0530" and x.isalpha() for x in s if x > "\x7f" and x not in token)
            if cost[0] - c[0] >= least and (usual or c[1] <= cost[1]) and (pair is None or mixed or not _mixes_scripts(s)):
                scored.append((c[0], s, c, pair))
        return min(scored, key=lambda x: x[:2]) if scored else None

    def token(self, token: str, pair: tuple[str, str] | None = None) -> tuple[str, tuple[str, str] | None]:
        """The repaired token, or the token itself; and the pair of encodings if single bytes were repaired.

        With a pair given, no other pair is tried.
        """
        if (known := self.done.get((token, pair))) is not None:
            return known
        now, cost, by = token, self.cost(token), None
        for _ in range(MOST_LAYERS):
            options = {}
            for p in _MAPS if pair is None else (pair,):
                if (s := "".join(_MAPS[p].get(c, c) for c in now)) != now:
                    options[s] = (LEAST_DROP_BYTE, p)
            options |= {s: (LEAST_DROP_UTF8, None) for e in READ_AS if (s := _from_utf8(now, _BYTES[e])) != now}
            if (best := self._better(now, cost, options)) is None:
                break
            _, now, cost, p = best
            by = p or by
        if len(self.done) > 300_000:
            self.done.clear()
        self.done[token, pair] = now, by
        return now, by

    def value(self, text: str) -> str:
        """text with its tokens repaired; a value's single-byte repairs follow the pair that most of them chose."""
        votes = Counter(p for w in TOKEN.findall(text) if not w.isascii() and (p := self.token(w)[1]))
        pair = votes.most_common(1)[0][0] if votes else None

        def fixed(m: re.Match[str]) -> str:
            if m[0].isascii():
                return m[0]
            s, p = self.token(m[0])
            if p and p != pair and (t := self.token(m[0], pair)[0]) != m[0]:
                return t
            return s

        return TOKEN.sub(fixed, text)


def _values(table: DataFrame, row_id: str, text: str, metadata: str | None, keys: tuple[str, ...]) -> DataFrame:
    """(row_id, field, value) of all values with a non-ASCII character."""
    pairs: list[Column] = [F.struct(F.lit(text).alias("field"), F.col(text).alias("value"))]
    pairs += [F.struct(F.lit(k).alias("field"), F.col(metadata)[k].alias("value")) for k in keys if metadata]
    return table.select(F.col(row_id).alias("row_id"), F.inline(F.array(*pairs))).where(F.col("value").rlike(r"[^\x00-\x7f]"))


def _counts(values: DataFrame) -> dict[int, int]:
    """Trigram counts over all values, at most 2**BITS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for token, n in Counter(w for v in batch.column(0).to_pylist() for w in TOKEN.findall(v) if not w.isascii()).items():
                for slot in _slots(token):
                    total[slot] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["slot", "n"])

    return {r.slot: r.n for r in values.select("value").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()}


def garbled(table: DataFrame, row_id: str = "row_id", text: str = "text", metadata: str | None = "metadata", keys: tuple[str, ...] = ("title", "author", "original_filename")) -> DataFrame:
    """(row_id, field, restored, lossy): each value that holds garbled characters, with its repair.

    field is the name of the text column or the metadata key. lossy tells that characters were replaced for good
    (U+FFFD), around which the rest is still repaired. Null, empty and pure ASCII values are never garbled; equal
    values in several rows count for each row. An empty table gives an empty result.
    """
    values = _values(table, row_id, text, metadata, keys)
    repairer_counts = _counts(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(repairer_counts)
        for batch in batches:
            value = batch.column(2).to_pylist()
            fixed = [repairer.value(v) for v in value]
            lossy = [LOST in v for v in value]
            keep = pa.array([f != v or x for f, v, x in zip(fixed, value, lossy)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fixed, pa.string()), pa.array(lossy)], ["row_id", "field", "restored", "lossy"]).filter(keep)

    return values.mapInArrow(run, f"row_id {table.schema[row_id].dataType.simpleString()}, field string, restored string, lossy boolean")
