"""Language-model scoring by online logistic context mixing.

A text is its tokens: lower-cased (A-Z) words between white space, each with a word end, then one end of text. Their
symbols are coded bit by bit along a fixed prefix code, made from the symbols' frequencies. For each bit several
predictors, one for each ``order``, give the odds seen in training where the same last bytes of the word, and the
same first bits of the symbol, came before. A mixer adds their log-odds with weights; which weights is decided by
a gate: the number of predictors that know the context, and how often the longest known one was seen. There are
several sets of such weights, which trust long contexts more or less. Each document starts with the same weights, and
they are refined along it: after every token, the weights of the gates that it met move against the gradient of what
the token cost by their set. How far each set holds is refined too, after every token, in proportion to the probability
that it gave the token (its posterior), starting evenly. So a token is predicted from what came before it only: the
probabilities of all token sequences add up to 1, and a document's score depends on the training rows and on itself.

Jobs: documents are packed into blocks, whose rows hold their distinct tokens and their texts as numbers of these.
Blocks ask for their tokens; dealt by token, these requests get the tokens' training counts. From them come the counts of (context, symbol), over all training
tokens, and a table of ``cells`` hashed contexts of 16 bits each (log-odds, trust, check): of contexts that meet in a
cell the more frequent stays. That table's size is fixed, so it is broadcast; everything else grows with the corpus
and stays in tables. Counts go back to the blocks that asked. There the predictors' odds are looked up once for each
distinct token, and the texts are coded side by side, a token of each at a time.

The base score is the additive unigram's: log10((c + a) / (N + a * (V + 1))) summed over tokens.

Defined cases: null and empty texts are an end alone; rows that share an id get a row each; without training rows
counts are 0 and all odds even; a null id is in no training fold's remainder and is held out; an empty table
gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flipside.llm.common import map_arrow, pieces, raw_texts, stored, trim

#: Symbols that no word has: its end, and the end of a text. They are white space.
WORD_END, TEXT_END = b" ", b"\n"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
STEP = 6.0  # steps of log-odds in one unit; a cell holds 64 each way, 2 bits of confidence and 7 bits of check
#: Sets of weights: of the longest known context and of the one before it, by trust.
SETS = (((0.55, 0.3), (0.75, 0.2), (0.9, 0.08), (0.97, 0.02)), ((0.65, 0.35), (0.9, 0.25), (1.05, 0.1), (1.1, 0.05)),
        ((0.3, 0.45), (0.45, 0.45), (0.6, 0.35), (0.7, 0.3)), ((0.2, 0.25), (0.3, 0.25), (0.4, 0.2), (0.5, 0.2)))
#: The counts from which a context is trusted more.
TRUST = (8, 64, 1024)
#: How far a token moves its weights: the rate of the gradient (of natural units by log-odds), and the most by one token.
RATE, MOST = 0.006, 0.06


def _numbers() -> defaultdict:
    """Gives each new key the next number."""
    out = defaultdict()
    out.default_factory = out.__len__
    return out


def _pack(block_bytes: int, kind: pa.DataType, arrow: pa.Schema):
    """Rows of blocks: their distinct tokens with training counts, and in one value, of Arrow's stream format, these and
    the documents with texts as numbers of tokens, so that the JVM carries bytes and not their millions of numbers."""
    inner = pa.schema([("ids", pa.list_(kind)), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
                       ("sequence", pa.list_(pa.int32())), ("tokens", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        numbers, ids, train, lengths, sequence = _numbers(), [], [], [], []

        def row() -> pa.RecordBatch:
            whole, taught = np.concatenate(sequence), np.repeat(train, lengths)
            tokens, sink = pa.array([list(numbers)], inner.field("tokens").type), pa.BufferOutputStream()
            texts = [pa.array([v], f.type) for v, f in zip((ids, train, lengths, whole), inner)] + [tokens]
            with pa.ipc.new_stream(sink, inner) as out:
                out.write_batch(pa.RecordBatch.from_arrays(texts, schema=inner))
            counts = np.bincount(whole[taught], minlength=len(numbers))
            values = pa.array([number]), tokens, pa.array([counts], arrow.field("counts").type), pa.array([sink.getvalue().to_pybytes()], pa.binary())
            return pa.RecordBatch.from_arrays(list(values), schema=arrow)

        for batch in (part for whole in batches for part in pieces(whole)):
            words = [t.lower().split() + [TEXT_END] for t in raw_texts(batch, "text")]
            sequence.append(np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int32, sum(map(len, words))))
            ids += batch["id"].to_pylist()
            train += batch["train"].to_pylist()
            lengths += map(len, words)
            size += batch["text"].nbytes
            if size >= block_bytes:
                yield row()
                number, size = number + 1, 0
                numbers, ids, train, lengths, sequence = _numbers(), [], [], [], []
                trim()
        if ids:
            yield row()
        numbers, sequence = _numbers(), []
        trim()

    return run


def _symbols(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the tokens with a word end before each; for each place the place of its token's first mark; and
    the places that are coded (all but the marks before)."""
    whole = np.frombuffer(b"".join([WORD_END + t + (b"" if t == TEXT_END else WORD_END) for t in tokens]), np.uint8)
    sizes = np.array([len(t) + (1 if t == TEXT_END else 2) for t in tokens], np.int64)
    starts = np.cumsum(sizes) - sizes
    coded = np.ones(len(whole), bool)
    coded[starts] = False
    return whole, np.repeat(starts, sizes), np.flatnonzero(coded)


def _contexts(whole: np.ndarray, first: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """A hash of the order and of the last ``order`` symbols of the token before each place."""
    hashed = np.full(len(places), order, np.uint64)
    for back in range(1, order + 1):
        at = places - back
        inside = at >= first[places]
        hashed = (hashed + np.where(inside, whole[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))) * _M1
        hashed ^= hashed >> np.uint64(29)
    return hashed * _M2


def _gather(orders: tuple[int, ...], arrow: pa.Schema, together: int = 200_000):
    """(context, symbol, n) of tokens in order, summed over ``together`` of them: neighbours share most contexts."""
    def counted(tokens: list[bytes], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole, first, places = _symbols(tokens)
        owner = np.searchsorted(np.unique(first), places, side="right") - 1
        for order in orders:
            context, symbol = _contexts(whole, first, places, order), whole[places]
            by = np.lexsort((symbol, context))
            context, symbol = context[by], symbol[by]
            new = np.ones(len(by), bool)
            new[1:] = (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])
            at = np.flatnonzero(new)
            columns = context[at].view(np.int64), symbol[at].astype(np.int32), np.add.reduceat(counts[owner[by]], at)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = [], []
        for batch in batches:
            tokens += batch["token"].to_pylist()
            counts += batch["c"].to_pylist()
            if len(tokens) >= together:
                yield from counted(tokens, np.array(counts, np.int64))
                tokens, counts = [], []
        if tokens:
            yield from counted(tokens, np.array(counts, np.int64))
        tokens = counts = None
        trim()

    return run


class Code:
    """A prefix code of the 256 bytes: for each the inner nodes on its way, and the bits taken there."""

    def __init__(self, frequencies: np.ndarray):
        heap = [(int(f) + 1, s, ((s, (), ()),)) for s, f in enumerate(frequencies)]
        heapq.heapify(heap)
        for node in range(255):
            (f0, s0, low), (f1, s1, high) = heapq.heappop(heap), heapq.heappop(heap)
            both = tuple((s, (node, *n), (bit, *b)) for bit, side in ((0, low), (1, high)) for s, n, b in side)
            heapq.heappush(heap, (f0 + f1, min(s0, s1), both))
        ways = sorted(heap[0][2])
        self.size = np.array([len(n) for _, n, _ in ways], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.nodes = np.array([x for _, n, _ in ways for x in n], np.uint64)
        self.bits = np.array([x for _, _, b in ways for x in b], np.int8)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit of each symbol: which symbol it is of, and its place in ``nodes`` and ``bits``."""
        return _ranges(self.start[symbols], self.size[symbols])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges one after another, and the number of the range that each value is from."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    return owner, np.arange(ends[-1] if len(ends) else 0) + (starts - (ends - sizes))[owner]


def _place(context: np.ndarray, node: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of a context at a node of the code, and its check (1 to 127)."""
    mixed = context + node
    mixed *= _M1
    mixed ^= mixed >> np.uint64(32)
    mixed *= _M2
    check = mixed >> np.uint64(8)
    check -= check // np.uint64(127) * np.uint64(127)   # numpy divides faster than it takes remainders
    return (mixed >> np.uint64(40)).astype(np.int64) & (cells - 1), check.astype(np.int64) + 1


def _cells(code: Code, cells: int):
    def step(batch):
        """From contexts with their symbols' counts: cell, n, and check and log-odds in one number. A context seen once
        tells nothing of what else may follow it and is left out, so that tokens seen once count as spelled."""
        lists = batch["seen"]
        symbols = lists.flatten().field("symbol").to_numpy()
        n = lists.flatten().field("n").to_numpy()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        of, way = code.expand(symbols)
        key = owner[of] * 256 + code.nodes[way].astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        weights, ones = n[of][order], code.bits[way][order]
        total, one = np.add.reduceat(weights, at), np.add.reduceat(weights * ones, at)
        again = total > 1
        at, total, one = at[again], total[again], one[again]
        odds = np.log((one + 0.4) / (total - one + 0.4))
        context = np.array(batch["context"].to_numpy()).view(np.uint64)[key[at] >> 8]
        cell, check = _place(context, (key[at] & 255).astype(np.uint64), cells)
        steps = np.clip(np.rint(odds * STEP), -63, 63).astype(np.int64) + 64
        return {"cell": cell, "n": total, "held": check << 9 | np.searchsorted(TRUST, total, side="right") << 7 | steps}

    return step


class Mixer:
    """The trained model: the code and the table of cells."""

    def __init__(self, code: Code, table: np.ndarray, orders: tuple[int, ...]):
        self.code, self.table, self.orders = code, table, orders
        #: By gate (number of known contexts, trust in the longest), predictor and set.
        self.weights = np.array([[[lead if i == gate - 1 else rest * 0.5 ** (gate - 2 - i) if i < gate else 0.0 for lead, rest in sets]
                                  for i in range(len(orders))] for gate in range(len(orders) + 1) for sets in zip(*SETS)], np.float32)

    def _steps(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``inputs``, with log-odds in steps."""
        whole, first, places = _symbols(tokens)
        of, way = self.code.expand(whole[places])
        node, sign = self.code.nodes[way], self.code.bits[way] * np.int8(2) - np.int8(1)
        odds = np.zeros((len(of), len(self.orders)), np.int8)
        known, trust = np.zeros(len(of), np.int8), np.zeros(len(of), np.int8)
        for k, order in enumerate(self.orders):
            cell, check = _place(_contexts(whole, first, places, order)[of], node, len(self.table))
            held = self.table[cell]
            match = held >> np.uint16(9) == check
            odds[:, k] = ((held & np.uint16(127)).astype(np.int8) - np.int8(64)) * sign * match
            known += match
            trust = np.where(match, (held >> np.uint16(7) & np.uint16(3)).astype(np.int8), trust)
        sizes = np.bincount(np.searchsorted(np.unique(first), first[places[of]]), minlength=len(tokens))
        return odds, known * (len(TRUST) + 1) + trust, sizes

    def inputs(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of the tokens, one token after another: the predictors' log-odds of the bit that comes, and the
        gate; for each token its number of bits."""
        odds, gate, sizes = self._steps(tokens)
        return odds.astype(np.float32) / np.float32(STEP), gate, sizes

    def costs(self, tokens: list[bytes], together: int = 8192) -> np.ndarray:
        """Bits that each token costs by each set of weights, as a text begins with them."""
        out = np.zeros((len(tokens), len(SETS)), np.float32)
        for at in range(0, len(tokens), together):
            odds, gate, size = self.inputs(tokens[at:at + together])
            for m in range(len(SETS)):
                z = np.einsum("ij,ij->i", odds, self.weights[gate, :, m])
                out[at:at + together, m] = np.add.reduceat(np.log2(1 + np.exp(-np.clip(z, -30, 15))), np.cumsum(size) - size)
        return out


class Refined:
    """Weights of texts side by side, each refined as its text goes on: what their next tokens cost by each set."""

    def __init__(self, mixer: Mixer, tokens: list[bytes], together: int = 1 << 14):
        predictors = len(mixer.orders)
        #: A bit in one number: the odds in steps, a byte each, and above them the gate.
        self.kind = np.dtype(np.int32 if predictors < 4 else np.int64)
        if predictors >= self.kind.itemsize:
            raise ValueError("at most 7 orders")
        self.first = np.ascontiguousarray(mixer.weights.transpose(0, 2, 1).reshape(len(mixer.weights), -1)) / np.float32(STEP)
        self.shape = len(tokens), len(SETS)
        self.predictors, self.weights = predictors, np.empty((0, self.first.shape[1]), np.float32)
        parts = list(_parts(tokens, together))
        self.size = np.concatenate([np.empty(0, np.int64)] + [self._sizes(mixer.code, part) for part in parts])
        self.start = np.cumsum(self.size) - self.size
        self.bits, at = np.empty(int(self.size.sum()), self.kind), 0
        for part in parts:
            odds, gate, sizes = mixer._steps(part)
            # of a token all bits are coded by the same weights, so those of a gate may stand together
            owner = np.repeat(np.arange(len(part), dtype=np.int32), sizes)
            by = np.argsort(owner * np.int32(len(self.first)) + gate, kind="stable")
            held = np.zeros((len(by), self.kind.itemsize), np.int8)
            held[:, :predictors], held[:, -1] = odds, gate
            self.bits[at:at + len(by)] = held.view(self.kind)[:, 0][by]
            at += len(by)

    @staticmethod
    def _sizes(code: Code, tokens: list[bytes]) -> np.ndarray:
        """How many bits each token has."""
        whole, first, places = _symbols(tokens)
        return np.add.reduceat(code.size[whole[places]], np.flatnonzero(np.diff(first[places], prepend=-1)))

    def begin(self, texts: int) -> None:
        self.weights = np.tile(self.first, (texts, 1))

    def step(self, tokens: np.ndarray, together: int = 1 << 16) -> np.ndarray:
        """What the next tokens of the first texts cost by each set, which then refines its weights. About ``together``
        bits are coded at once."""
        out, done = np.empty((len(tokens), len(SETS)), np.float32), 0
        ends = np.cumsum(self.size[tokens])
        while done < len(tokens):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + together, side="right")))
            out[done:upto] = self._coded(done, tokens[done:upto]).T
            done = upto
        return out

    def _coded(self, text: int, tokens: np.ndarray) -> np.ndarray:
        sizes = self.size[tokens]
        ends = np.cumsum(sizes)
        firsts, n = ends - sizes, int(ends[-1])
        place = np.repeat(self.start[tokens] - firsts, sizes)
        place += np.arange(n)
        held, whole = self.bits.take(place), self.kind.type(8 * (self.kind.itemsize - 1))
        odds = np.empty((self.predictors, n), np.float32)
        for k in range(self.predictors):
            odds[k] = held << (whole - self.kind.type(8 * k)) >> whole
        held >>= whole
        held += np.repeat(np.arange(text, text + len(tokens), dtype=self.kind) * self.kind.type(len(self.first)), sizes)
        # runs of bits that are coded by the same weights
        run = np.append(0, np.flatnonzero(held[1:] != held[:-1]) + 1)
        row = held[run]
        weights = self.weights[row].T
        each = np.repeat(weights, np.diff(run, append=n), axis=1).reshape(-1, self.predictors, n)
        each *= odds
        rest = each[:, 0]
        for k in range(1, self.predictors):
            rest = rest + each[:, k]
        rest = np.exp(-np.clip(rest, -15, 30))
        inverse = rest + np.float32(1)   # of the probability
        with np.errstate(over="ignore"):
            product = np.multiply.reduceat(inverse, firsts, axis=1)
        cost = np.log2(product)
        for i in np.flatnonzero(np.isinf(product).any(axis=0)):
            cost[:, i] = np.log2(inverse[:, firsts[i]:ends[i]]).sum(axis=1)
        np.multiply((rest / inverse)[:, None], odds, out=each)
        moved = np.add.reduceat(each.reshape(-1, n), run, axis=1)
        moved *= np.float32(RATE / STEP**2)
        self.weights[row] = (weights + np.clip(moved, -MOST / STEP, MOST / STEP)).T
        return cost


def _parts(tokens: list[bytes], together: int) -> Iterator[list[bytes]]:
    """The tokens in lists of about ``together`` bytes."""
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    at = 0
    while at < len(tokens):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, side="right")))
        yield tokens[at:upto]
        at = upto


def text_bits(costs: np.ndarray | Refined, sequence: np.ndarray, lengths: np.ndarray, together: int = 1 << 16, side: int = 1024) -> np.ndarray:
    """Bits that each text costs. A text starts with even shares of the sets; token after token it pays for what the
    sets give the token by their shares, and each share is multiplied by the probability that its set gave the token
    and brought back to a sum of 1. Shares are kept as logarithms, so that none is lost. What a token costs by the sets
    is given for good, or ``Refined`` as its text goes on. ``side`` texts take their next token at once, the longest
    first, so that those that have one come first; ``together`` bounds the tokens fetched."""
    order = np.argsort(-lengths, kind="stable")
    starts, out = np.cumsum(lengths) - lengths, np.empty(len(lengths))
    for at in range(0, len(order), side):
        some = order[at:at + side]
        out[some] = _side_by_side(costs, sequence, starts[some], lengths[some], together)
    return out


def _side_by_side(costs: np.ndarray | Refined, sequence: np.ndarray, starts: np.ndarray, ends: np.ndarray, together: int) -> np.ndarray:
    """``text_bits`` of texts that begin at ``starts`` and have ``ends`` tokens, the longest first."""
    refined, bits = isinstance(costs, Refined), np.zeros(len(ends))
    if refined:
        costs.begin(len(ends))
    shares = np.full((len(ends), costs.shape[1]), np.log2(costs.shape[1]))   # in bits, as costs are
    longest, active, at = int(ends[0]), len(ends), 0
    while at < longest:
        active = int(np.searchsorted(-ends[:active], -at, side="left"))   # texts of more than ``at`` tokens
        steps = max(1, min(longest - at, together // active))
        places = np.minimum(starts[:active, None] + np.arange(at, at + steps), len(sequence) - 1)
        tokens = sequence[places]
        each = None if refined else costs[tokens].astype(float)
        for step in range(steps):
            active = int(np.searchsorted(-ends[:active], -(at + step), side="left"))
            both = shares[:active] + (costs.step(tokens[:active, step]) if refined else each[:active, step])
            least = both.min(axis=1)
            paid = least - np.log2(np.exp2(least[:, None] - both).sum(axis=1))
            bits[:active] += paid
            shares[:active] = both - paid[:, None]
        at += steps
    return bits


def _score(model, n_train: int, distinct: int, add: float, arrow: pa.Schema):
    """Texts of blocks that come as a row with texts and tokens (place -1) and then rows with their tokens' counts."""
    def scored(texts: dict, counts: np.ndarray) -> pa.RecordBatch:
        lengths, sequence, tokens = texts["lengths"].to_numpy(), texts["sequence"].to_numpy(), texts["tokens"].to_pylist()
        text = np.repeat(np.arange(len(lengths)), lengths)
        each = np.log10((counts + add) / (n_train + add * (distinct + 1)))
        base, known = np.bincount(text, each[sequence], len(lengths)), np.bincount(text, counts[sequence] > 0, len(lengths))
        sizes = np.array([len(t) + (t != TEXT_END) for t in tokens], np.int64)
        symbols = np.bincount(text, sizes[sequence], len(lengths))
        del text
        bits = text_bits(Refined(model.value, tokens), sequence, lengths)
        columns = {"id": texts["ids"], "train": texts["train"], "n_tokens": lengths, "n_known": known.astype(np.int64),
                   "base_score": base, "score": -bits * np.log10(2), "bits_per_byte": bits / symbols}
        return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts, held, batch = None, [], None, None
        for batch in batches:
            places = batch["place"].to_numpy()
            cuts = np.flatnonzero(places < 0).tolist() + [len(places)]
            for at, (start, end) in enumerate(zip([0, *cuts], cuts)):
                if at:  # the row at ``start`` has texts
                    if texts:
                        yield scored(texts, np.concatenate(counts))
                        trim()
                    held = pa.ipc.open_stream(batch["texts"][start].as_buffer()).read_next_batch()
                    texts, counts = {c: held[c][0].values for c in held.schema.names}, []
                    start += 1
                counts.append(batch["c"].slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64))
        if texts:
            yield scored(texts, np.concatenate(counts))
        texts = held = batch = None
        trim()

    return run


def fit(types: DataFrame, orders: tuple[int, ...] = (1, 3, 6), cells: int = 1 << 23) -> Mixer:
    """The model of (token, c): training tokens with their counts, best in order. ``cells`` is a power of 2, up to 2^24."""
    schema = StructType.fromDDL("context long, symbol int, n long")
    seen = types.select("token", "c").mapInArrow(_gather(orders, to_arrow_schema(schema)), schema)
    # dealt by context once: the sum over (context, symbol) and the list of a context's symbols (256 at most) stay in place
    seen = seen.repartition("context").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    seen = stored(seen.groupBy("context").agg(F.collect_list(F.struct("symbol", "n")).alias("seen")), "contexts")
    # every coded symbol has one context of the first order: the byte before it
    first = np.unique(_contexts(*_every_pair(), 1)).view(np.int64).tolist()
    frequencies = np.zeros(256, np.int64)
    used = seen.where(F.col("context").isin(first)).select(F.explode("seen").alias("s"))
    for symbol, n in used.groupBy("s.symbol").agg(F.sum("s.n")).collect():
        frequencies[symbol] = n
    code = Code(frequencies)
    held = map_arrow(seen, "cell int, n long, held int", _cells, code, cells)
    held = held.groupBy("cell").agg(F.max(F.struct("n", "held")).alias("most")).select("cell", F.col("most.held").alias("held"))
    found = held.toArrow()
    table = np.zeros(cells, np.uint16)
    table[found["cell"].to_numpy()] = found["held"].to_numpy()
    return Mixer(code, table, orders)


def _every_pair() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte before another one."""
    whole = np.repeat(np.arange(256, dtype=np.uint8), 2)
    places = np.arange(1, 512, 2)
    return whole, np.arange(512) // 2 * 2, places


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1,
                orders: tuple[int, ...] = (1, 3, 6), cells: int = 1 << 23, block_bytes: int = 8 << 20) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte; learns from rows where
    ``train`` holds. ``orders`` begin with 1."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = StructType.fromDDL("block long, tokens array<binary>, counts array<long>, texts binary")
    ids = to_arrow_schema(docs.select("id").schema).field("id").type
    blocks = stored(docs.mapInArrow(_pack(block_bytes, ids, to_arrow_schema(schema)), schema), "lm-blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("tokens", "counts")).alias("place", "t")).select(
        "block", "place", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    # dealt by token once; what a token needs is asked for by blocks, which bounds its rows, and neighbours stay neighbours
    same = Window.partitionBy("token").orderBy("block")
    every = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = asked.withColumn("c", F.sum("n").over(every)).withColumn("first", F.row_number().over(same) == 1)
    asked = stored(asked.drop("n"), "lm-tokens")
    types = asked.where("first AND c > 0").select("token", "c")
    n_train, distinct = types.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = df.sparkSession.sparkContext.broadcast(fit(types, orders, cells))
    asked = asked.select("block", "place", "c")
    whole = blocks.select("block", F.lit(-1).alias("place"), F.lit(0).cast("long").alias("c"), "texts")
    whole = whole.union(asked.withColumn("texts", F.lit(b""))).repartition("block").sortWithinPartitions("block", "place")
    schema = StructType.fromDDL(f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    out = whole.mapInArrow(_score(model, n_train, distinct, add, to_arrow_schema(schema)), schema)
    return out.withColumn("train_tokens", F.lit(n_train).cast("long")).withColumnRenamed("id", id_col)
