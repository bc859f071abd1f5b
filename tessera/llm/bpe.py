"""Byte-pair encoding and decoding through a table of distinct words.

Spark splits texts into words. Words are encoded in two tables, so that each is encoded once: the
``FREQUENT`` most common words of a sample (a bound on the broadcast; which words it holds changes speed
only) are encoded and broadcast, and all other words go to the partition of their hash, where equal words
meet and are encoded together. Their ids travel back to the rows they came from and are joined in by
position. A row's words travel as compressed numbers, its text does not. Decoding joins ids with the
table of pieces, which the vocabulary bounds.

Null texts count as empty and encode to no ids. Other columns pass through unchanged; columns named like
the outputs are replaced. Very long texts are cut into segments where no word crosses. An empty table
gives an empty table. Equal rows are kept each. The rows are read twice and must be the same both times, as
those of files or of a checkpoint are.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, MapType, StringType, StructField, StructType

from tessera.llm._blocks import fresh, lean, release
from tessera.llm._text import unvarint, varints

#: The pre-tokenizer's pattern, a fixed value of this public vocabulary; capitals stand for classes of characters.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?LETTER+| ?NUMBER+| ?OTHER+|SPACE+(?!SOLID)|SPACE+"
#: Letters and numbers of Unicode 14 to 16, fixed values: the tokenizer knows them, a JVM may not.
LATER_LETTERS = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3 a7d5-a7dc a7f2-a7f4
10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107ba
10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075 1123f-11240 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11740-11746
11ab0-11abf 11bc0-11be0 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff
1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0
1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af
"""
LATER_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"
#: Words of the broadcast table; share of the texts (one in so many) that it is taken from, and bytes of these at most.
FREQUENT, SAMPLE, SAMPLE_BYTES = 1 << 19, 8, 128 << 20
SEGMENT, SHORT = 50_000, 64
FLUSH_BYTES, ROWS_AT_ONCE = 4 << 20, 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """What the public vocabulary file holds: pieces by id, merge ranks and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        ids = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for piece, i in ids.items():
            self.pieces[i] = piece
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.single = [ids.get(bytes([b]), -1) for b in range(256)]
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[ids[left] << 32 | ids[right]] = rank << 32 | ids[left + right]

    def encode(self, word: str) -> bytes:
        """A word's ids as little-endian 32-bit integers. The best-ranked merge goes first, from left to right."""
        if word in self.special:
            return self.special[word].to_bytes(4, "little")
        ids = [self.single[b] for b in word.encode()]
        n, ranks, none = len(ids), self.ranks, 1 << 64
        if n <= SHORT:
            rank = [ranks.get(a << 32 | b, none) for a, b in pairwise(ids)]
            while rank and (best := min(rank)) != none:
                i = rank.index(best)
                ids[i : i + 2] = [best & 0xFFFFFFFF]
                del rank[i]
                if i:
                    rank[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], none)
                if i < len(rank):
                    rank[i] = ranks.get(ids[i] << 32 | ids[i + 1], none)
            return struct.pack(f"<{len(ids)}I", *ids)
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = best & 0xFFFFFFFF, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (f := ranks.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (f, left, ids[left], ids[right]))
        return np.array([x for x, keep in zip(ids, alive, strict=True) if keep], dtype="<u4").tobytes()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]



# ---- splitting, in Spark


def _class(kind: str, later: str) -> str:
    return kind + "".join("-".join(rf"\x{{{x}}}" for x in part.split("-")) for part in later.split())


SPACE, LETTER, NUMBER = r"\p{IsWhite_Space}", _class(r"\p{L}", LATER_LETTERS), _class(r"\p{N}", LATER_NUMBERS)
CLASSES = {"SPACE": f"[{SPACE}]", "SOLID": f"[^{SPACE}]", "LETTER": f"[{LETTER}]", "NUMBER": f"[{NUMBER}]", "OTHER": f"[^{SPACE}{LETTER}{NUMBER}]"}


#: The same for texts without characters from U+0870 on, where all versions of Unicode agree; shorter classes match faster.
OLD_CLASSES = CLASSES | {"LETTER": r"\p{L}", "NUMBER": r"\p{N}", "OTHER": rf"[^{SPACE}\p{{L}}\p{{N}}]"}
LATER = r"[\x{870}-\x{10FFFF}]"


def pattern(form: str = PATTERN, classes: dict[str, str] = CLASSES) -> str:
    """The pattern in the JVM's notation."""
    return re.sub("|".join(classes), lambda m: classes[m[0]], form)


def segments(text: Column, special: list[str], size: int = SEGMENT) -> Column:
    """The text in parts that no word crosses: special strings alone, and parts that end before white space."""
    parts = F.array(text)
    if special:
        quoted = "|".join(rf"\Q{s}\E" for s in sorted(special, key=len, reverse=True))
        apart = F.filter(F.split(text, f"(?<={quoted})|(?={quoted})"), lambda s: s != "")
        parts = F.when(F.greatest(*(F.contains(text, F.lit(s)).cast("int") for s in special), F.lit(0)) == 1, apart).otherwise(parts)
    # a word begins with white space or follows it but for what it follows without any: so it ends before the next white space
    cut = pattern(rf"(?s).{{1,{size}}}(?<=SOLID)(?=SPACE|\z)|.{{1,{size}}}SPACE*SOLID*")
    short = F.length(text) <= size
    return F.when(short, parts).otherwise(F.flatten(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit(cut), F.lit(0)))))


def words(segment: Column, special: list[str]) -> Column:
    """The words of a segment; a special string is one word."""
    of = lambda classes: F.regexp_extract_all(segment, F.lit(pattern(classes=classes)), F.lit(0))
    found = F.when(segment.rlike(LATER), of(CLASSES)).otherwise(of(OLD_CLASSES))
    return F.when(segment.isin(special), F.array(segment)).otherwise(found) if special else found


def _text(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[text].cast("string"), F.lit(""))


# ---- encoding


def _encoded(path: str, words: DataFrame) -> DataFrame:
    """word and ids of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["word"], pa.array([v.encode(w) for w in b["word"].to_pylist()], pa.binary())], names=["word", "ids"])
        release()

    return words.select("word").mapInArrow(run, "word string, ids binary")


def _answered(path: str, sorted_words: DataFrame, key: str) -> DataFrame:
    """For rows (word, key, no) in the order of words: key and packed, the numbers and ids of some of its words. Each word is encoded once, equal rows are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, last, ids, before = vocabulary(path), None, [], None
        held: dict[bytes, list[int]] = {}
        size = 0

        def made() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held.values())])
            whole = np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(x, dtype=np.int64) for x in held.values())])
            data, at = varints(whole)
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.BinaryArray.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(data)])], names=[key, "packed"])

        for b in batches:
            for x in zip(*(b[c].to_pylist() for c in ("word", key, "no")), strict=True):
                if x == before:
                    continue
                before = x
                if x[0] != last:
                    last = x[0]
                    ids = np.frombuffer(v.encode(last), dtype="<u4").tolist()
                held.setdefault(x[1], []).extend((x[2], len(ids), *ids))
                size += len(ids) + 8
            if size > ROWS_AT_ONCE:
                yield made()
                held.clear()
                size = 0
        if held:
            yield made()
        held.clear()
        release()

    return sorted_words.mapInArrow(run, StructType([sorted_words.schema[key], StructField("packed", BinaryType())]))


def frequent(docs: DataFrame, path: str, text: str, special: list[str], most: int = FREQUENT, sample_bytes: int = SAMPLE_BYTES) -> pa.Table:
    """word and ids of the most frequent words of one text in SAMPLE, or of fewer texts of about sample_bytes; ``most`` at most."""
    whole = docs.select(_text(docs, text).alias("t"))
    total = whole.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    sample = whole.where(F.pmod(F.xxhash64(F.lit(5), "t"), F.lit(max(SAMPLE, total // sample_bytes))) == 0)
    counts = sample.select(F.explode(segments(F.col("t"), special)).alias("s")).select(F.explode(words(F.col("s"), special)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return _encoded(path, counts.orderBy(F.desc("n"), "word").limit(most)).toArrow().combine_chunks()


def _packed(codes: np.ndarray) -> bytes:
    """Numbers in one, two, three or five bytes, the smaller the shorter; first bytes first, compressed."""
    one, two, three = 128, 128 + (64 << 8), 128 + (64 << 8) + (63 << 16)
    x = codes
    kind = (x >= one).astype(np.int8) + (x >= two) + (x >= three)
    y = x - np.array([0, one, two, 0])[kind]
    head = np.choose(kind, [y, 128 | y >> 8, 192 | y >> 16, 255]).astype(np.uint8)
    rest = [y[kind == 1].astype("<u1"), y[kind == 2].astype("<u2"), x[kind == 3].astype("<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in (head, *rest))) + len(x).to_bytes(8, "little") if len(x) else b""


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.int64)
    n, data = int.from_bytes(raw[-8:], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[:-8]), dtype=np.uint8)
    head = data[:n].astype(np.int64)
    kind = (head >= 128).astype(np.int8) + (head >= 192) + (head == 255)
    out, at = head.copy(), n
    for k, width, first, least in ((1, 1, 128, 128), (2, 2, 192, 128 + (64 << 8)), (3, 4, 255, 0)):
        here = kind == k
        size = int(here.sum()) * width
        low = np.frombuffer(data[at : at + size].tobytes(), dtype=f"<u{width}").astype(np.int64)
        out[here] = ((head[here] - first) << 8 * width) + low + least
        at += size
    return out


def _rows(batches: Iterator[pa.RecordBatch], seg: str, found: str, table: pa.Array) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, list[str]]]:
    """For each text its first batch and row, its words' numbers in the table, and the words beyond: number len(table) and following."""
    most, held, row, codes, rare = len(table), None, 0, [], {}
    for b in batches:
        column = b[found]
        flat, ends = column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        code = pc.index_in(flat, value_set=table).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(code < 0)
        other = flat.take(pa.array(at)).to_pylist()
        upto = np.searchsorted(at, ends).tolist()
        begin, before = 0, 0
        for r, (first, end) in enumerate(zip(b[seg].to_pylist(), ends.tolist(), strict=True)):
            if first == 0:
                if held is not None:
                    yield held, row, np.concatenate(codes), list(rare)
                held, row, codes, rare = b, r, [], {}
            mine = code[begin:end]
            if upto[r] > before:
                mine[at[before : upto[r]] - begin] = [most + rare.setdefault(w, len(rare)) for w in other[before : upto[r]]]
            codes.append(mine)
            begin, before = end, upto[r]
    if held is not None:
        yield held, row, np.concatenate(codes), list(rare)


def _flushed(rows: Iterator[tuple], fields: list[str], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of the rows' fields and values (batch, row, size, *values), a few MB each; rows of one batch follow each other."""
    held, at, size, values = None, [], 0, []

    def made() -> pa.RecordBatch:
        kept = held.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([kept[f] for f in fields] + [pa.array(list(x), k) for x, k in zip(zip(*values, strict=True), kinds, strict=True)], names=[*fields, *names])

    for batch, row, n, *x in rows:
        if held is not None and (batch is not held or size > FLUSH_BYTES):
            yield made()
            at, size, values = [], 0, []
        held = batch
        at.append(row)
        size += n + 64
        values.append(x)
    if held is not None:
        yield made()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", most: int = FREQUENT, decoded: str | None = None) -> DataFrame:
    """docs with the text column replaced by ids: little-endian unsigned 32-bit integers, packed in a binary column.

    decoded: a column for what the ids stand for, joined with the pieces as ``decode`` does, in the same pass.
    """
    lean(docs.sparkSession)
    docs = docs.drop(*({ids, decoded} - {text, None}))
    special = list(vocabulary(path).special)
    rest = [c for c in docs.columns if c != text]
    t, key, seg, found, codes, answers = fresh([*rest, ids, decoded or ids], "t", "key", "seg", "words", "codes", "answers")
    kept = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text, special, most))

    plain = [F.col(f"`{c}`") for c in rest if not _has_map(docs.schema[c].dataType)]
    whole = docs.withColumn(t, _text(docs, text))
    # a row is known by 88 bits of its text's digest, and copies of a text are spread over 64 keys by what else their rows hold
    spread = F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(0), *plain), F.lit(64))), 2, "0")
    whole = whole.select(*[F.col(f"`{c}`") for c in rest], F.unhex(F.concat(F.substring(F.sha2(t, 256), 1, 22), spread)).alias(key), F.posexplode(segments(F.col(t), special)).alias(seg, t))
    split = whole.withColumn(found, words(F.col(t), special)).drop(t)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = _column(kept.value, "word", pa.string()), set()
        keys, nos, words = [], [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(nos, pa.int32()), pa.array(words, pa.string())], names=[key, "no", "word"])

        last, mine_of = None, []
        for b, r, _, other in _rows(batches, seg, found, table):
            if b is not last:
                last, mine_of = b, b[key].to_pylist()
            mine = mine_of[r]
            if not other or mine in seen:
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(mine)
            keys.extend([mine] * len(other))
            nos.extend(range(len(other)))
            words.extend(other)
            if len(words) > ROWS_AT_ONCE:
                yield made()
                keys, nos, words = [], [], []
        if words:
            yield made()
        release()

    keyed = StructField(key, BinaryType())
    beyond = split.select(key, seg, found).mapInArrow(rare, StructType([keyed, StructField("no", IntegerType()), StructField("word", StringType())])).repartition("word").sortWithinPartitions("word", key, "no")
    known = _answered(path, beyond, key).groupBy(key).agg(F.collect_list("packed").alias(answers))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, r, len(x), x) for b, r, c, _ in _rows(batches, seg, found, _column(kept.value, "word", pa.string())) for x in (_packed(c),))
        yield from _flushed(rows, [*rest, key], [codes], [pa.binary()])
        release()

    fields = [docs.schema[c] for c in rest]
    coded = split.mapInArrow(numbered, StructType([*fields, keyed, StructField(codes, BinaryType())]))
    joined = coded.join(known, key, "left").select(*[F.col(f"`{c}`") for c in rest], codes, answers)

    pieces = _pieces(docs, path) if decoded else None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_ids = _column(kept.value, "ids", pa.binary())
        for batch in batches:
            begin, size, held = 0, 0, []
            for row, raw in enumerate(batch[codes].to_pylist()):
                held.append(_unpacked(raw))
                size += 8 * len(held[-1])
                if size >= FLUSH_BYTES or row == batch.num_rows - 1:
                    part = batch.slice(begin, len(held))
                    made = _joined(held, part[answers], known_ids)
                    back = [_texts([np.frombuffer(x.as_buffer(), dtype="<u4") for x in made], pieces.value)] if pieces else []
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), made, *back], names=[*rest, ids, *([decoded] if pieces else [])])
                    begin, size, held = row + 1, 0, []
        release()

    return joined.mapInArrow(fill, StructType([*fields, StructField(ids, BinaryType()), *([StructField(decoded, StringType())] if decoded else [])]))


def _column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    return table[name].chunk(0) if table.num_rows else pa.array([], kind)


def _joined(rows: list[np.ndarray], answers: pa.ListArray, known: pa.Array) -> pa.Array:
    """Each row's ids: its words' numbers joined with the broadcast table and, beyond it, with the row's own answers."""
    flat = answers.flatten()
    of = np.repeat(np.arange(len(rows)), pc.list_value_length(answers).fill_null(0).to_numpy(zero_copy_only=False))
    sizes = np.cumsum([0, *pc.binary_length(flat).to_pylist()])
    numbers, byte_ends = unvarint(np.frombuffer(b"".join(flat.to_pylist()), dtype=np.uint8))
    listed, at, i = numbers.tolist(), [], 0
    while i < len(listed):  # number of the word, how many ids, the ids
        at.append(i)
        i += 2 + listed[i + 1]
    place = np.array(at, dtype=np.int64)
    no, many = numbers[place], numbers[place + 1]
    row = of[np.searchsorted(sizes, byte_ends[place], side="right") - 1] if len(place) else place
    order = np.lexsort((no, row))
    many, first = many[order], place[order] + 2
    ends = np.concatenate([[0], np.cumsum(many)])
    own = numbers[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])].astype("<u4")
    mine = pa.BinaryArray.from_buffers(pa.binary(), len(many), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(own.tobytes())])
    base = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))])
    row_ends = np.cumsum([0, *map(len, rows)])
    codes = np.concatenate([np.zeros(0, dtype=np.int64), *rows])
    codes += np.where(codes >= len(known), np.repeat(base[:-1], np.diff(row_ends)), 0)
    return _grouped(pa.concat_arrays([known, mine]).take(pa.array(codes)), row_ends)


def _grouped(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Neighbouring binary values concatenated: those from ends[i] to ends[i + 1] are the i-th."""
    if not len(values):
        return pa.array([b""] * (len(ends) - 1), pa.binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[ends])), data])


def _has_map(kind) -> bool:
    """Maps have no hash in Spark."""
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or kind.typeName() == "variant" or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


# ---- decoding


def _pieces(df: DataFrame, path: str):
    """The table of pieces, a row for each id of the vocabulary and an empty one for all others, broadcast."""
    return df.sparkSession.sparkContext.broadcast(pa.array([*vocabulary(path).pieces, b""], pa.binary()))


def _texts(rows: list[np.ndarray], pieces: pa.Array) -> pa.Array:
    """The texts of rows of ids: all ids are joined with the pieces, and those of a row concatenated."""
    flat = np.minimum(np.concatenate([np.zeros(0, dtype="<u4"), *rows]), len(pieces) - 1)
    made = _grouped(pieces.take(pa.array(flat)), np.cumsum([0, *map(len, rows)]))
    return pa.array([x.as_py().decode("utf-8", "replace") for x in made], pa.string())


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the packed ids replaced by the text they stand for (null: empty). An id without a piece stands for nothing.

    Each batch's ids are joined with the table of pieces, which the vocabulary bounds and which is broadcast.
    """
    lean(encoded.sparkSession)
    encoded = encoded if text == ids else encoded.drop(text)
    rest = [c for c in encoded.columns if c != ids]
    pieces = _pieces(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, held = 0, 0, []
            for row, raw in enumerate(batch[ids]):
                held.append(np.frombuffer(raw.as_buffer() or b"", dtype="<u4"))
                size += 4 * len(held[-1])
                if size >= FLUSH_BYTES or row == batch.num_rows - 1:
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in rest), _texts(held, pieces.value)], names=[*rest, text])
                    begin, size, held = row + 1, 0, []
        release()

    return encoded.mapInArrow(run, StructType([*(encoded.schema[c] for c in rest), StructField(text, StringType())]))


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
