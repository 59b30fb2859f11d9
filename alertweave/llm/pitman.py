"""Log probabilities of texts under a hierarchical Pitman-Yor bigram model learnt from the corpus.

Every word is a restaurant whose customers are the words that follow it; all of them share one parent, the restaurant of words
as such, whose customers are the tables of its children, and above that any word is as likely as any other. Seatings are
sampled by Gibbs: customers leave and sit down again at a table as large as it is, less the discount, or at a new one as
likely as the parent finds the word. The probabilities of several seatings are averaged.

How it is spread. Documents are taken together into batches; each counts its pairs once. Pairs meet in shards by the hash of
the context, contexts with more tokens than a shard has on average in several shards by the hash of the word too; words meet
in shards by their own hash. A pair seen once has one table and needs no sampling. Shards keep the tables of the others and send, per
sweep, one number per word they hold; the word shards sum them, seat the parent's customers, and answer with one number
each. So a sweep moves some bytes per distinct word of a shard, never pairs or customers, and no restaurant is in one place.
All that is counted grows with the input; the driver sees a few sums and the contexts that are dealt out, at most as many as
there are shards.

In a sweep every customer of every pair leaves once and sits down again. Customers of different words do so at the same time,
seeing the tables of before, and so do those of one pair beyond 32 customers, one in 32 of them at a time; the parent
seats all of its customers anew each time, those beyond 32 in steps of one in 32.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle
from alertweave.session import Scratch

#: Words of a batch, pairs of a shard on average, distinct words of a word shard. Larger ones for larger clusters.
BATCH = 1 << 20
PAIRS = 1 << 19
WORDS = 1 << 20
#: Sweeps before and while seatings are averaged, each of which seats every customer anew, and in how many parts those of a pair move.
BURN, SAMPLES, PARTS = 3, 3, 32
STRENGTH = 1.0
#: Words are known by 56 bits of their hash; two of a billion words fall together with a chance of about one in 70 million.
MASK = (1 << 56) - 1
END = b"\n"  # no word holds white space

ROW = "shard long, kind string, peer long, a binary, b binary, c binary, x double, y double"
NAMES = [part.split()[0] for part in ROW.split(", ")]
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """An array as bytes, the bytes of one weight next to each other."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(chr(data[0]))
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def small(values: np.ndarray) -> np.ndarray:
    """Counts in the fewest bytes."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def pack_series(series: list[np.ndarray]) -> bytes:
    """Whole numbers that hardly change from one array to the next."""
    return pickle.dumps([pack(small(series[0])), *[pack(after.astype(np.int64) - before.astype(np.int64)) for before, after in zip(series, series[1:], strict=False)]])


def unpack_series(data: bytes) -> np.ndarray:
    return np.cumsum([unpack(packed).astype(np.int64) for packed in pickle.loads(data)], axis=0)


def _dump(**arrays: np.ndarray) -> bytes:
    return pickle.dumps({name: pack(values) for name, values in arrays.items()})


def _load(data: bytes) -> dict[str, np.ndarray]:
    return {name: unpack(packed) for name, packed in pickle.loads(data).items()}


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(29))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    rows = [(*row, *[None] * (len(NAMES) - len(row))) for row in rows]
    return pa.Table.from_arrays([pa.array([row[k] for row in rows], schema.field(k).type) for k in range(len(NAMES))], schema=schema)


SCHEMA = pa.schema(
    [("shard", pa.int64()), ("kind", pa.string()), ("peer", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("x", pa.float64()), ("y", pa.float64())]
)


def _by_kind(group: pa.Table) -> dict[str, list[dict]]:
    out: defaultdict[str, list[dict]] = defaultdict(list)
    for row in group.to_pylist():
        out[row["kind"]].append(row)
    for rows in out.values():
        rows.sort(key=lambda row: row["peer"])  # the same result whatever order the rows arrive in
    return out


def _grouped(rows: DataFrame, step: Callable[[int, dict[str, list[dict]]], list[tuple]]) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        return _table(step(group.column("shard")[0].as_py(), _by_kind(group)), SCHEMA)

    return rows.groupBy("shard").applyInArrow(run, ROW)


def _each(rows: DataFrame, step: Callable[[dict], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _table(step(row), SCHEMA).to_batches()

    return rows.mapInArrow(run, ROW)


def _batches(size: int):
    """Documents to rows of kind `batch`: a the words' keys, b the tokens as places among them, c (ids, held out, tokens) of each."""

    def flush(docs: list, lists: list[np.ndarray], number: defaultdict, name: int) -> pa.Table:
        hashes = np.array([xxhash.xxh64_intdigest(word) & MASK for word in number], np.uint64)
        keys, place = np.unique(hashes, return_inverse=True)
        tokens = place[np.concatenate(lists)].astype(np.uint32)
        sizes = np.array([len(x) for x in lists], np.int64)
        held = np.array([doc is None or zlib.crc32(str(doc).encode()) % 10 == 0 for doc in docs])
        about = pickle.dumps((docs, held, sizes))
        return _table([(name, "batch", 0, pack_sorted(keys), pack(tokens), about, float(len(keys)), float(len(tokens)))], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, part = TaskContext.get().partitionId() << 32, 0

        def fresh() -> tuple[list, list, defaultdict]:
            number: defaultdict[bytes, int] = defaultdict(count().__next__)
            number[END]
            return [], [], number

        docs, lists, number = fresh()
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                words.append(END)
                docs.append(doc)
                lists.append(np.array(list(map(number.__getitem__, words)), np.uint32))
                held += len(words)
                if held >= size:
                    yield from flush(docs, lists, number, base + part).to_batches()
                    docs, lists, number = fresh()
                    held, part = 0, part + 1
        if docs:
            yield from flush(docs, lists, number, base + part).to_batches()

    return run


@dataclass
class Batch:
    """A batch read back: its words, tokens, and distinct pairs of a token and the one before it, END before the first."""

    row: dict
    docs: list = field(init=False)

    def __post_init__(self):
        self.keys, self.tokens = unpack_sorted(self.row["a"]), unpack(self.row["b"]).astype(np.int64)
        self.docs, self.held, self.sizes = pickle.loads(self.row["c"])
        self.learnt = np.repeat(~self.held, self.sizes)

    def pairs(self) -> None:
        n = len(self.keys)
        # Documents end with END, so what stands before a document's first word is END.
        codes = np.concatenate([self.tokens[-1:], self.tokens[:-1]]) * n + self.tokens
        codes, self.place = np.unique(codes, return_inverse=True)
        self.context, self.word = codes // n, codes % n

    def word_parts(self, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return _dealt((self.keys % np.uint64(shards)).astype(np.int64))

    def pair_parts(self, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        context, word = self.keys[self.context], self.keys[self.word]
        return _dealt(pair_shard(context, word, shards, hot))


def pair_shard(context: np.ndarray, word: np.ndarray, shards: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of each pair: by its context, and for contexts in `hot` (sorted keys, number of shards) by its word too."""
    keys, salts = hot
    shard = mixed(context)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
        spread = np.where(keys[at] == context, salts[at], 1).astype(np.uint64)
        shard = shard % np.uint64(shards) + mixed(word) % spread
    return (shard % np.uint64(shards)).astype(np.int64)


def _dealt(shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct shards and the places that go to each of them, in order."""
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    return names, np.split(order, first[1:]) if len(names) else []


def _word_requests(shards: int):
    def step(row: dict) -> list[tuple]:
        batch = Batch(row)
        learnt = np.bincount(batch.tokens[batch.learnt], minlength=len(batch.keys))
        return [(int(s), "request", row["shard"], pack_sorted(batch.keys[own]), pack(small(learnt[own]))) for s, own in zip(*batch.word_parts(shards), strict=True)]

    return step


def _summed(rows: list[dict], *columns: str) -> list[np.ndarray]:
    """The distinct keys of the rows, sorted, and the sums of each column over them."""
    if not rows:
        return [np.zeros(0, np.uint64), *[np.zeros(0, np.int64) for _ in columns]]
    keys, place = np.unique(np.concatenate([unpack_sorted(row["a"]) for row in rows]), return_inverse=True)
    out = [keys]
    for column in columns:
        values = np.concatenate([unpack(row[column]) for row in rows])
        out.append(np.bincount(place, values, len(keys)).astype(np.int64))
    return out


def _word_totals(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
    keys, counts = _summed(kinds["request"], "b")
    return [(shard, "words", -1, pack_sorted(keys), _dump(count=counts), None, float(counts.sum()), float((counts > 0).sum()))]


def _hot(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _load(row["b"])["count"]
                many = counts > limit
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(row["a"])[many].astype(np.int64)), pa.array(counts[many])], ["key", "n"])

    return run


def _pair_requests(shards: int, hot: tuple[np.ndarray, np.ndarray]):
    def step(row: dict) -> list[tuple]:
        batch = Batch(row)
        batch.pairs()
        learnt = np.bincount(batch.place[batch.learnt], minlength=len(batch.context))
        out = []
        for s, own in zip(*batch.pair_parts(shards, hot), strict=True):
            context, word = batch.keys[batch.context[own]], batch.keys[batch.word[own]]
            out.append((int(s), "request", row["shard"], pack_sorted(context), pack(word), pack(small(learnt[own]))))
        return out

    return step


def _seated_pairs(word_shards: int):
    """A shard's pairs: the answers owed to each batch, the pairs seen more than once, a table each, and sums for the word shards."""

    def step(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
        requests = kinds["request"]
        parts = [(unpack_sorted(row["a"]), unpack(row["b"]), unpack(row["c"]).astype(np.int64)) for row in requests]
        context, word, learnt = (np.concatenate(part) for part in zip(*parts, strict=True))
        order = np.lexsort((word, context))
        context, word, learnt = context[order], word[order], learnt[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        of = np.cumsum(new) - 1
        total = np.bincount(of, learnt).astype(np.int64)
        context, word = context[new], word[new]
        # Pairs seen more than once, those with most customers first.
        often = np.flatnonzero(total > 1)
        often = often[np.argsort(-total[often], kind="stable")]
        code = (total == 1).astype(np.int64)
        code[often] = 2 + np.arange(len(often))
        back = np.empty(len(order), np.int64)
        back[order] = code[of]
        out, start = [], 0
        for row, part in zip(requests, parts, strict=True):
            out.append((shard, "answer", row["peer"], pack(small(back[start : start + len(part[0])]))))
            start += len(part[0])
        tables = np.ones(len(often), np.int64)  # seated for good in the first sweep, when the parent is known
        once = total == 1
        contexts, context_of = np.unique(context[total > 0], return_inverse=True)
        fixed = np.bincount(context_of, once[total > 0], len(contexts)).astype(np.int64)
        words, word_of = np.unique(word[often], return_inverse=True)
        at = np.searchsorted(contexts, context[often])
        state = _dump(contexts=contexts, fixed=small(fixed), words=words, context=small(at), word=small(word_of), count=small(total[often]), sizes=small(total[often]), tables=small(tables), summed=np.zeros(len(often), np.uint32))
        out.append((shard, "state", -1, state, pickle.dumps([]), None, float((total == 1).sum()), float((total == 2).sum())))
        singles, single_count = np.unique(word[once], return_counts=True)
        for s, own in zip(*_dealt((singles % np.uint64(word_shards)).astype(np.int64)), strict=True):
            out.append((int(s), "ones", shard, pack_sorted(singles[own]), pack(small(single_count[own]))))
        return out + _sums(shard, words, np.bincount(word_of, tables, len(words)).astype(np.int64), word_shards)

    return step


def _sums(shard: int, words: np.ndarray, tables: np.ndarray, word_shards: int) -> list[tuple]:
    dealt = zip(*_dealt((words % np.uint64(word_shards)).astype(np.int64)), strict=True)
    return [(int(s), "sum", shard, pack_sorted(words[own]), pack(small(tables[own]))) for s, own in dealt]


@dataclass(frozen=True)
class Root:
    """What the parent's probabilities need beside a word's own number: its customers and tables, known words, and discount."""

    customers: float
    tables: float
    known: float
    discount: float

    @property
    def rest(self) -> float:
        return (STRENGTH + self.discount * self.tables) / (self.known + 1)

    def probability(self, value: np.ndarray) -> np.ndarray:
        return (value + self.rest) / (STRENGTH + self.customers)


def reseat(rng: np.random.Generator, sizes: np.ndarray, tables: np.ndarray, count_: np.ndarray, context: np.ndarray, held: np.ndarray, parent: np.ndarray, discount: float):
    """Every customer of each pair leaves once, in random order, and sits down again. Pairs come with falling counts of two or more.

    Pairs of up to PARTS customers move them one at a time, larger ones one in PARTS of them. `sizes` are the customers of all
    tables, pair by pair, `tables` how many each pair has; `held` the tables of each context.
    Gives the new sizes and tables; `held` is changed in place.
    """
    own, tables, count_ = sizes.astype(np.int64), tables.astype(np.int64), count_.astype(np.int64)
    length = tables.copy()  # slots of each pair: its tables, and those left empty on the way
    first = np.cumsum(length) - length
    queue = np.cumsum(count_) - count_
    seat_of = np.repeat(np.arange(len(own)) - np.repeat(first, length), own)  # as a place among the pair's slots
    seat_of = seat_of[np.argsort(np.repeat(np.arange(len(count_)), count_) + rng.random(len(seat_of)))]
    done: list[np.ndarray] = []
    for part in range(PARTS):
        k = int(np.searchsorted(-count_, -part, side="left"))  # pairs with more than `part` customers
        if k == 0:
            break
        n, at, length, first = count_[:k], context[:k], length[:k], first[:k]
        end = int(first[-1] + length[-1])
        done.append(own[end:])
        own = own[:end]
        parts = np.minimum(n, PARTS)
        start, leave = n * part // parts, n * (part + 1) // parts - n * part // parts
        pair = np.repeat(np.arange(k), leave)
        left = first[pair] + seat_of[np.repeat(queue[:k] + start - np.cumsum(leave) + leave, leave) + np.arange(len(pair))]
        own = own - np.bincount(left, minlength=end)
        emptied = np.unique(left[own[left] == 0])
        gone = np.bincount(np.searchsorted(first, emptied, side="right") - 1, minlength=k)
        tables[:k] -= gone
        np.subtract.at(held, at, gone)
        fresh = (STRENGTH + discount * held[at]) * parent[:k]
        join = n - leave - discount * tables[:k]
        opens = rng.random(len(pair)) * (fresh + join)[pair] < fresh[pair]
        free = own - discount * (own > 0)
        weight = np.cumsum(free)
        chosen = np.searchsorted(weight, (weight[first] - free[first])[pair] + rng.random(len(pair)) * join[pair], side="right")
        chosen = np.clip(chosen, first[pair], (first + length - 1)[pair])
        chosen = np.where(own[chosen] > 0, chosen, left)  # rounding at the edge of a pair: back to the old seat
        opens |= own[chosen] == 0
        own = own + np.bincount(chosen[~opens], minlength=end)
        opened = np.bincount(pair[opens], minlength=k)
        own = np.insert(own, np.repeat(first + length, opened), 1)
        length = length + opened
        first = np.cumsum(length) - length
        tables[:k] += opened
        np.add.at(held, at, opened)
    slots = np.concatenate([own, *done[::-1]])
    return slots[slots > 0], tables


def first_seating(rng: np.random.Generator, count_: np.ndarray, rest: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, tables) of pairs with so many customers: tables as if they came in one after the other, the rest dealt out over them by Dirichlet's law."""
    tables = seat(rng, count_, rest, discount)
    if not len(tables):
        return tables, tables
    weight = np.maximum(rng.gamma(1 - discount, size=int(tables.sum())), 1e-300)
    last = np.cumsum(tables) - 1
    of = np.repeat(np.arange(len(tables)), tables)
    # The shares of a pair's tables sum up to 1, so their running sum less the pairs before is the share up to a table.
    share = np.cumsum(weight / np.add.reduceat(weight, last + 1 - tables)[of]) - of
    seats = np.floor(np.clip(share, 0, 1) * (count_ - tables)[of]).astype(np.int64)
    seats[last] = count_ - tables
    sizes = 1 + np.diff(seats, prepend=0)
    sizes[last + 1 - tables] = 1 + seats[last + 1 - tables]
    return sizes, tables


def _sweep(number: int, root: Root, discount: float, word_shards: int, shared: tuple[np.ndarray, np.ndarray], sample: bool):
    """One sweep of a shard's pairs. `shared`: contexts in several shards, and the tables that all shards had for them."""

    def step(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
        state = _load(kinds["state"][0]["a"])
        samples = pickle.loads(kinds["state"][0]["b"])
        order = np.argsort(state["words"] % np.uint64(word_shards), kind="stable")
        value = np.empty(len(order))
        if len(order):
            value[order] = np.concatenate([unpack(row["a"]) for row in kinds["value"]])
        at, word = state["context"].astype(np.int64), state["word"].astype(np.int64)
        count_, tables, sizes = (state[name].astype(np.int64) for name in ("count", "tables", "sizes"))
        parent = root.probability(value)[word]
        rng = np.random.Generator(np.random.PCG64([number, shard]))
        there = _elsewhere(state["contexts"], shared, kinds["state"][0]["c"])
        if number == 1:
            sizes, tables = first_seating(rng, count_, (STRENGTH + discount * _tables_of_contexts(state)[at]) * parent, discount)
            state["tables"] = tables
        held = _tables_of_contexts(state) + there
        sizes, tables = reseat(rng, sizes, tables, count_, at, held, parent, discount)
        summed = state["summed"] + (tables if sample else 0)
        state |= {"sizes": small(sizes), "tables": small(tables), "summed": summed.astype(np.uint64)}
        own = _tables_of_contexts(state)
        if sample:
            samples.append(pack(small(own)))
        mine = np.isin(state["contexts"], shared[0])
        sent = _dump(keys=state["contexts"][mine], tables=own[mine])
        out = [(shard, "state", -1, _dump(**state), pickle.dumps(samples), sent)]
        return out + _sums(shard, state["words"], np.bincount(word, tables, len(state["words"])).astype(np.int64), word_shards)

    return step


def _tables_of_contexts(state: dict[str, np.ndarray]) -> np.ndarray:
    return state["fixed"] + np.bincount(state["context"].astype(np.int64), state["tables"], len(state["contexts"])).astype(np.int64)


def _elsewhere(contexts: np.ndarray, shared: tuple[np.ndarray, np.ndarray], sent: bytes | None) -> np.ndarray:
    """Tables of contexts that other shards hold too: their sum at the last sweep less what this shard had sent then."""
    keys, sums = shared
    out = np.zeros(len(contexts), np.int64)
    if len(keys) and sent:
        before = _load(sent)
        at = np.searchsorted(contexts, before["keys"])
        out[at] = sums[np.searchsorted(keys, before["keys"])] - before["tables"]
    return np.maximum(out, 0)


def _sent_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sent in batch.column("c").to_pylist():
            if sent:
                held = _load(sent)
                yield pa.RecordBatch.from_arrays([pa.array(held["keys"].astype(np.int64)), pa.array(held["tables"].astype(np.int64))], ["key", "n"])


def seat(rng: np.random.Generator, customers: np.ndarray, rest: np.ndarray | float, discount: float) -> np.ndarray:
    """Tables of dishes with so many customers, seated one after the other; beyond 32, one in 32 of those seated at a time.

    `rest` is the weight of a new table.
    """
    order = np.argsort(-customers, kind="stable")
    left, rest = customers[order], np.broadcast_to(rest, len(customers))[order]
    tables = (left > 0).astype(np.int64)
    seated = 1
    while True:
        k = int(np.searchsorted(-left, -seated, side="left"))  # dishes with more customers than are seated
        if k == 0:
            break
        step = max(1, seated // 32)
        p = rest[:k] / (rest[:k] + seated - discount * tables[:k])
        tables[:k] += rng.binomial(np.minimum(step, left[:k] - seated), p)
        seated += step
    out = np.empty(len(order), np.int64)
    out[order] = tables
    return out


def _parent(number: int, root: Root, sample: bool):
    """The parent's customers are the children's tables; each shard that sent sums is told (customers - discount * tables)."""

    def step(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
        row = kinds["words"][0]
        keys, held = unpack_sorted(row["a"]), _load(row["b"])
        samples = pickle.loads(row["c"]) if row["c"] else []
        fixed = held.get("fixed")
        if fixed is None:
            fixed = np.zeros(len(keys), np.int64)
            own, ones = _summed(kinds["ones"], "b")
            fixed[np.searchsorted(keys, own)] = ones
        customers = fixed.astype(np.int64)
        own, tables = _summed(kinds["sum"], "b")
        customers[np.searchsorted(keys, own)] += tables
        seated = seat(np.random.Generator(np.random.PCG64([number, shard, 1])), customers, root.rest, root.discount)
        value = customers - root.discount * seated
        if sample:
            samples.append((pack(small(customers)), pack(small(seated))))
        held = _dump(count=small(held["count"]), fixed=small(fixed))
        out = [(shard, "words", -1, row["a"], held, pickle.dumps(samples))]
        out.append((shard, "total", -1, None, None, None, float(customers.sum()), float(seated.sum())))
        out.append((shard, "few", -1, None, None, None, float((customers == 1).sum()), float((customers == 2).sum())))
        for asked in kinds["sum"]:
            out.append((asked["peer"], "value", shard, pack(value[np.searchsorted(keys, unpack_sorted(asked["a"]))])))
        return out

    return step


def _pair_values(samples: int, discount: float, word_shards: int):
    """To each batch, (customers - discount * average tables) of its pairs; to the word shards, the tables of the contexts in each sample."""

    def step(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
        row = kinds["state"][0]
        state = _load(row["a"])
        often = state["count"] - discount * state["summed"] / samples
        values = np.concatenate([[0.0, 1.0 - discount], often]).astype(np.float32)
        out = [(asked["peer"], "pairs", shard, pack(values[unpack(asked["a"])])) for asked in kinds["answer"]]
        tables = [unpack(packed) for packed in pickle.loads(row["b"])]
        keys = state["contexts"]
        for s, own in zip(*_dealt((keys % np.uint64(word_shards)).astype(np.int64)), strict=True):
            out.append((int(s), "contexts", shard, pack_sorted(keys[own]), pickle.dumps([pack(part[own]) for part in tables])))
        return out

    return step


def _word_values(samples: int):
    """To each batch: counts of its words, their tables as contexts, and their customers and tables in the parent, by sample."""

    def step(shard: int, kinds: dict[str, list[dict]]) -> list[tuple]:
        row = kinds["words"][0]
        keys, counts = unpack_sorted(row["a"]), _load(row["b"])["count"]
        tables = np.zeros((samples, len(keys)), np.int64)
        for part in kinds["contexts"]:
            at = np.searchsorted(keys, unpack_sorted(part["a"]))
            for k, own in enumerate(pickle.loads(part["b"])):
                tables[k, at] += unpack(own)  # a context's tables may lie in several shards
        seats = [[unpack(packed) for packed in part] for part in zip(*pickle.loads(row["c"]), strict=True)]
        out = []
        for asked in kinds["request"]:
            at = np.searchsorted(keys, unpack_sorted(asked["a"]))
            told = pickle.dumps([pack_series([own[at] for own in part]) for part in seats])
            out.append((asked["peer"], "words", shard, pack(counts[at]), pack_series([own[at] for own in tables]), told))
        return out

    return step


def _scored(roots: list[Root], discount: float, word_shards: int, pair_shards: int, hot: tuple[np.ndarray, np.ndarray], train_tokens: int, known: int):
    def run(group: pa.Table) -> pa.Table:
        kinds = _by_kind(group)
        batch = Batch(kinds["batch"][0])
        batch.pairs()
        counts = np.empty(len(batch.keys), np.int64)
        tables, parent = np.empty((len(roots), len(batch.keys))), np.empty((len(roots), len(batch.keys)))
        for row, own in zip(kinds["words"], batch.word_parts(word_shards)[1], strict=True):
            counts[own] = unpack(row["a"])
            tables[:, own] = unpack_series(row["b"])
            customers, seated = map(unpack_series, pickle.loads(row["c"]))
            for k, root in enumerate(roots):
                parent[k, own] = root.probability(customers[k] - root.discount * seated[k])
        value = np.empty(len(batch.context))
        for row, own in zip(kinds["pairs"], batch.pair_parts(pair_shards, hot)[1], strict=True):
            value[own] = unpack(row["a"])
        u, w = batch.context, batch.word
        lent = np.mean([(STRENGTH + discount * t[u]) * p[w] for t, p in zip(tables, parent, strict=True)], axis=0)
        score = np.log10((value + lent) / (STRENGTH + counts[u]))[batch.place]
        base = np.log10((counts + 0.1) / (train_tokens + 0.1 * (known + 1)))[batch.tokens]
        first = np.cumsum(batch.sizes) - batch.sizes
        columns = [
            pa.array(batch.docs, pa.int64()),
            pa.array(batch.held),
            pa.array(batch.sizes),
            pa.array(np.add.reduceat((counts > 0).astype(np.int64)[batch.tokens], first)),
            pa.array(np.full(len(first), train_tokens)),
            pa.array(np.add.reduceat(base, first)),
            pa.array(np.add.reduceat(score, first)),
        ]
        return pa.Table.from_arrays(columns, [part.split()[0] for part in RESULT.split(", ")])

    return run


def _discount(once: float, twice: float) -> float:
    """The usual estimate from how many have been seen once and twice."""
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def score(documents: DataFrame, batch_words: int = BATCH, shard_pairs: int = PAIRS, shard_words: int = WORDS, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """RESULT's columns for every document (doc_id, text): what a plain unigram model and the bigram model give its text, in log10.

    A-Z are lower-cased; tokens are the words between ASCII white space and one end. Learnt from are the documents whose
    checksum of the id is not divisible by 10; the others are held out, and so are rows without id. Null texts are empty:
    their one token is the end. Repeated rows count each time; other columns are not read; an empty table gives no rows. If
    nothing is learnt from, every probability is 1. A document is in one batch however long it is, read by one task.
    """
    spark = documents.sparkSession
    settle(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    batches = cut(texts.mapInArrow(_batches(batch_words), ROW))
    size = batches.agg(F.sum("x"), F.sum("y")).first()
    word_shards = max(1, round((size[0] or 0) / shard_words))
    pair_shards = max(1, round((size[1] or 0) / shard_pairs))

    with Scratch() as older:
        words = cut(_grouped(_each(batches, _word_requests(word_shards)), _word_totals))
    learnt = words.agg(F.sum("x"), F.sum("y")).first()
    train_tokens, known = int(learnt[0] or 0), int(learnt[1] or 0)
    limit = max(train_tokens / pair_shards, 1)
    found = words.select("a", "b").mapInArrow(_hot(limit), "key long, n long").orderBy("key").toArrow()  # fewer rows than pair shards
    spread = np.ceil(found.column("n").to_numpy() / limit).astype(np.int64)
    hot = found.column("key").to_numpy().astype(np.uint64), np.minimum(spread, pair_shards)

    with Scratch() as paired:
        pairs = cut(_grouped(_each(batches, _pair_requests(pair_shards, hot)), _seated_pairs(word_shards)))
    few = pairs.where("kind = 'state'").agg(F.sum("x"), F.sum("y")).first()
    discount = _discount(few[0] or 0, few[1] or 0)
    with Scratch() as answered:
        answers = cut(pairs.where("kind = 'answer'"))
    # What a step has stored goes when the next one of its kind has.
    with Scratch() as seated:
        state = cut(pairs.where("kind = 'state'"))
    root, parents = Root(0.0, known, known, discount), discount
    shared = hot[0], np.zeros(len(hot[0]), np.int64)
    sums = pairs.where("kind in ('ones', 'sum')")
    roots: list[Root] = []
    for number in range(burn + samples + 1):
        sample = number > burn
        if number:
            with Scratch() as newer:
                moved = cut(_grouped(state.unionByName(told.where("kind = 'value'")), _sweep(number, root, discount, word_shards, shared, sample)))
            seated.drop(spark)
            seated, state, sums = newer, moved.where("kind = 'state'"), moved.where("kind = 'sum'")
            if len(hot[0]):
                sent = state.select("c").mapInArrow(_sent_tables, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
                shared = sent.column("key").to_numpy().astype(np.uint64), sent.column("n").to_numpy()
        seen = Root(root.customers, root.tables, known, parents)
        with Scratch() as newer:
            told = cut(_grouped(words.unionByName(sums), _parent(number, seen, sample)))
        older.drop(spark)
        paired.drop(spark)
        older, words = newer, told.where("kind = 'words'")
        totals = {row.kind: row for row in told.where("kind in ('total', 'few')").groupBy("kind").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
        if totals:
            root = Root(totals["total"].x, totals["total"].y, known, parents)
            if number == 0:
                parents = _discount(totals["few"].x, totals["few"].y)
        roots += [root] * sample
    values = cut(_grouped(state.unionByName(answers), _pair_values(samples, discount, word_shards)))
    seated.drop(spark)
    answered.drop(spark)
    asked = _each(batches, _word_requests(word_shards))
    told = _grouped(words.unionByName(values.where("kind = 'contexts'")).unionByName(asked), _word_values(samples))
    everything = batches.unionByName(values.where("kind = 'pairs'")).unionByName(told)
    return everything.groupBy("shard").applyInArrow(_scored(roots, discount, word_shards, pair_shards, hot, train_tokens, known), RESULT)
