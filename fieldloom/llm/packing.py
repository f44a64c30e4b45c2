"""Best-fit packing: token pieces into few sequences, by a configuration linear program over the length histogram.

1. Every whole text becomes token ids and a closing id; only longer ones are cut into full pieces, the first may be shorter. The
   pieces (without ids) are written to the shared folder, so that numbers given to them later stay the same when tasks are repeated.
2. Spark counts the pieces per length: at most ``capacity`` numbers reach the driver, whatever the corpus size.
3. The linear program "cover all counts with fillings of one sequence" is solved by multiplicative weights: a length that lags behind
   in coverage gains value, and a knapsack dynamic program prices the most valuable filling, alone and around each lagging length.
   Fractions are rounded down to whole sequences; the pieces left, which have the same mix of lengths, are packed by best fit.
4. Piece number r of a length goes to the sequence and place that the solution gives to its r-th piece. Numbers come from a window over
   (length, hash bucket) plus the bucket's offset, so that no length, however frequent, is numbered by one task.

Defined cases: null texts count as empty and yield one piece with the closing id; repeated rows and repeated or null ids yield pieces of
their own; an empty table yields no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bytes_of, slices, texts_of
from fieldloom.session import materialise

CAPACITY = 1024
END_ID = 2
CACHED_SEGMENTS = 600_000
ROUNDS = 128
# The split pattern of the byte-level vocabulary, and the characters and single words that need no general splitter.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"[\t\n\r -~¡-ɏ]*"
SINGLE = r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)"


def kinds_of(data: np.ndarray) -> np.ndarray:
    """For every UTF-8 byte: 1 letter, 2 digit, 3 space, 4 punctuation but for the apostrophe, and 0 for all that is left alone.

    Letters are those of ASCII and the two-byte ones that begin with C3, which holds two other signs (97 and B7).
    """
    table = np.zeros(256, np.uint8)
    table[33:127] = 4
    table[48:58] = 2
    table[65:91] = table[97:123] = 1
    table[32], table[39] = 3, 0
    kind = table[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def segments(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where to cut the texts so that no token crosses a cut: where letters, digits and punctuation meet, and before a single
    space between two of them. Around all other characters nothing is cut."""
    kind = kinds_of(data)
    word = (kind == 1) | (kind == 2) | (kind == 4)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = word[:-1] & word[1:] & (kind[:-1] != kind[1:])
    cut[1:-2] |= word[:-2] & (kind[1:-1] == 3) & word[2:]
    cut[at] = True
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole texts. Equal segments are tokenised once; a bounded cache holds them."""

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.split, self.plain, self.single = self.tokenizer.model, regex.compile(SPLIT), regex.compile(PLAIN), re.compile(SINGLE)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}
        self.known: dict = {}

    def word(self, raw: bytes) -> list:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]

    def segment(self, raw: bytes) -> np.ndarray:
        """Ids of one segment: a single word goes to the model at once, plain text is split first, and the rest is for the library."""
        text = raw.decode()
        if self.single.fullmatch(text):
            found = self.word(raw)
        elif self.plain.fullmatch(text):
            found = [i for w in self.split.findall(text) for i in self.word(w.encode())]
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry than texts). A text that spells out an added token goes through the library whole."""
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.by_segments(texts)
        ids, at = self.by_segments(pc.if_else(pa.array(odd), "", texts))
        own = [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if odd[i] else ids[at[i]:at[i + 1]] for i in range(len(texts))]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    def by_segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = bytes_of(texts)
        if len(data) == 0:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        cuts = segments(data, at)
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        known, own = self.known, []
        for raw in coded.dictionary.to_pylist():
            ids = known.get(raw)
            if ids is None:
                ids = self.segment(raw)
                if len(raw) < 64:
                    known[raw] = ids
            own.append(ids)
        if len(known) > CACHED_SEGMENTS:
            known.clear()
        size = np.fromiter(map(len, own), np.int64, len(own))
        flat, first = np.concatenate(own), np.cumsum(size) - size
        code = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[code]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(first[code] - (ends - sizes), sizes)
        return flat[places], np.concatenate([[0], ends])[np.searchsorted(cuts, at)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of every piece of every text."""
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", "text")

    def cut(batches):
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, at = encoder.encode(texts_of(part, "text"))
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                for row in range(part.num_rows):
                    own = np.append(ids[at[row]:at[row + 1]], np.uint32(end_id)).astype("<u4")
                    pieces = -(-len(own) // capacity)
                    edge = 0
                    for k in range(pieces):
                        end = len(own) - capacity * (pieces - 1 - k)
                        rows.append(row), piece.append(k), start.append(edge), length.append(end - edge), crc.append(zlib.crc32(own[edge:end].tobytes()))
                        if with_ids:
                            kept.append(own[edge:end].astype(np.int32))
                        edge = end
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the most value in every room from 0 to ``capacity``, and the length taken first there (0: one unit stays empty)."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        with_each = best[room - 1::-1][:room] + value[1:room + 1]
        k = int(with_each.argmax())
        if with_each[k] > best[room - 1]:
            best[room], take[room] = with_each[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, take


def filling(take: np.ndarray, room: int, first: int = 0) -> dict[int, int]:
    """The lengths of one sequence: ``first`` and the best filling of what is left."""
    out = {first: 1} if first else {}
    room -= first
    while room > 0:
        length = int(take[room])
        if length:
            out[length] = out.get(length, 0) + 1
        room -= length or 1
    return out


def fractions(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = 0.5) -> dict[tuple, float]:
    """Approximate solution of the covering program by multiplicative weights: filling -> how many sequences (a fraction).

    The dual values of a packing without waste are the lengths themselves. Round k prices every length by that value times the
    exponential of how far its coverage lags behind k / rounds, and takes, for each lagging length, the most valuable filling around
    it. No length may run ahead by more than one round, so short pieces stay available for what is left at the end.
    """
    lengths = np.flatnonzero(demand)
    covered = np.zeros(capacity + 1)
    out: dict[tuple, float] = {}
    for k in range(1, rounds + 1):
        limit = np.minimum(1.0, (k + 1) / rounds) * demand
        value = np.zeros(capacity + 1)
        value[lengths] = lengths * np.exp(rate * (k / rounds - covered[lengths] / demand[lengths]))
        value[lengths[covered[lengths] >= limit[lengths] - 1e-9]] = 0
        _, take = price(value, capacity)
        for length in lengths[::-1]:
            need = demand[length] * k / rounds - covered[length]
            if need <= 1e-9:
                continue
            pattern = filling(take, capacity, int(length))
            if sum(x * n for x, n in pattern.items()) < capacity:
                continue  # wait for prices that fill the sequence
            amount = min([need / pattern[length], *((limit[x] - covered[x]) / n for x, n in pattern.items() if x != length)])
            if amount > 1e-9:
                for x, n in pattern.items():
                    covered[x] += n * amount
                key = tuple(sorted(pattern.items()))
                out[key] = out.get(key, 0.0) + amount
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The sequences that best-fit decreasing opens for the pieces left: each goes to the fullest sequence that has room.

    Sequences of equal filling move together, so the work does not follow the number of pieces.
    """
    rooms: list[dict] = [{} for _ in range(capacity + 1)]  # room left -> filling -> sequences
    for length in np.flatnonzero(left)[::-1].tolist():
        pieces, room = int(left[length]), length
        while pieces:
            while room < capacity and not rooms[room]:
                room += 1
            if room < capacity:
                key, there = next(iter(rooms[room].items()))
                moved = min(there, pieces)
                if moved == there:
                    del rooms[room][key]
                else:
                    rooms[room][key] = there - moved
            else:  # open new ones, and fill each before the next, as the last opened is the fullest
                copies = capacity // length
                key, moved = (), -(-pieces // copies)
                if moved > 1:
                    moved, full = moved - 1, ((length, copies),)
                    at = rooms[capacity - length * copies]
                    at[full] = at.get(full, 0) + moved
                    pieces -= moved * copies
                    room = length
                    continue
            before = dict(key)
            before[length] = before.get(length, 0) + 1
            key, room_after = tuple(before.items()), room - length
            rooms[room_after][key] = rooms[room_after].get(key, 0) + moved
            pieces -= moved
            room = length
    return [(dict(key), times) for at in rooms for key, times in at.items()]


def solve(demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many sequences get each, covering ``demand`` (pieces per length, index 0 unused) exactly."""
    left, plan = demand.astype(np.int64).copy(), []

    def use(pattern, times):
        plan.append((pattern, int(times)))
        for x, n in pattern.items():
            left[x] -= n * int(times)

    if left[capacity]:
        use({capacity: 1}, left[capacity])
    for key, amount in sorted(fractions(left, capacity, rounds).items(), key=lambda kv: (-kv[1], kv[0])):
        times = min([math.floor(amount), *(left[x] // n for x, n in key)])
        if times > 0:
            use(dict(key), times)
    plan += best_fit(left, capacity)
    return plan


def place(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For every run of equal pieces in equal fillings: length, number of its first piece, copies per sequence, first sequence, place of the first copy."""
    runs, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            runs.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    rows = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {name: rows[:, i] for i, name in enumerate(("length", "first", "copies", "sequence", "offset"))}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a stored table with ``length``) with ``sequence_id`` and ``offset``."""
    sizes = pieces.groupBy("length").count().collect()  # one row per length: at most ``capacity``
    demand = np.zeros(capacity + 1, np.int64)
    for row in sizes:
        demand[row["length"]] = row["count"]
    runs = place(solve(demand, capacity))
    buckets = max(1, math.isqrt(int(demand.sum())))
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)).cast("int"))
    offsets = marked.groupBy("length", "_bucket").count().select(
        "length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("count")).alias("_before"))
    order = [c for c in pieces.columns if c != "length"]
    numbered = marked.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    ranked = numbered.join(offsets, ["length", "_bucket"]).select(*pieces.columns, (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    place_of = [i for i, c in enumerate(ranked.columns) if c == "length"][0]
    names = [*pieces.columns, "sequence_id", "offset"]

    def assign(batches):
        span = int(demand.max()) + 1
        starts = runs["length"] * span + runs["first"]
        for batch in batches:
            length, rank = batch.column(place_of).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            run = np.searchsorted(starts, length * span + rank, side="right") - 1
            nth = rank - runs["first"][run]
            sequence = runs["sequence"][run] + nth // runs["copies"][run]
            offset = runs["offset"][run] + nth % runs["copies"][run] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    return ranked.mapInArrow(assign, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, from placed pieces with their ids; a sequence has at most ``capacity`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
