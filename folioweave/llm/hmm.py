"""Language-model scoring by a hidden Markov model, and by add-one unigrams as its base.

Every training word has emissions of its own. Those of the frequent words are broadcast; those of all others stand in a
table that each text's words are joined with, backed off to classes by last letters, which unseen words have alone.
A first Baum-Welch pass over the training documents, a fold at a time, tells the latent states apart; further ones count
all training documents alike, and the last of them gives the model. The scaled forward recursion gives each whole text's
exact likelihood.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.shared import SharedTables, byte_view, fold, list_array, pieces, text_or_empty
from folioweave.llm.words import lower

#: Words whose emissions are broadcast at most, classes of the others, latent states. Symbols fit 16 bits.
WORDS, CLASSES, STATES = 40_000, 2_000, 8
#: Bytes up to which a word stands for itself in tables and broadcasts; longer ones go by their digest, which bounds both.
LONGEST = 64
#: Share of a word's counts that goes to each state, whatever its contexts; infrequent words that a task sums before it lets go.
FLOOR, SUMMED = 0.01, 400_000
#: Bytes of text that are taken apart at once; counts of words that a task holds before it sums them.
TEXT_BYTES, HELD_WORDS = 4 << 20, 1_000_000
#: Passes over all training documents after the stepwise one; tokens whose states a task holds at once.
PASSES, HELD_TOKENS = 2, 1 << 18
#: Bytes of symbols of texts that are gone through abreast; steps after which their states are scaled.
ABREAST, SCALED = 4 << 20, 4
#: Rows of the encoded table that are scored together with what their infrequent words have; a power of 2.
BLOCK = 4096
FOLDS, HELD = 7, 2
#: Folds that are joined with their words' emissions together; one lot after the other bounds the disk that shuffles take.
LOTS = ((0, 1), (2, 3), (4, 5), (6,))
#: The end of a text; no word, as words hold no blank.
END = b" "


def tokens(text: bytes) -> list[bytes]:
    r"""A-Z lower-cased words [^\x20\x09-\x0D]+, then the end.

    A word over LONGEST bytes is a blank (no word holds one), its SHA-256 and its last letters, by which it has its class.
    """
    words = [*text.lower().split(), END]
    if max(map(len, words)) > LONGEST:
        words = [w if len(w) <= LONGEST else _digest(w) for w in words]
    return words


def _digest(word: bytes) -> bytes:
    return b" " + sha256(word).digest() + word[-3:]


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(tokens() of each of the binary texts, one text after the other; each text's first, and the number of all)."""
    data, offsets = byte_view(texts)  # Arrow's own lower-casing misreads slices
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(lower(data))]))
    found = lists.flatten().view(pa.large_binary())
    size = pc.binary_length(found).to_numpy(zero_copy_only=False)
    # white space at a text's edges leaves an empty word there
    kept = np.flatnonzero(size)
    of = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    first = np.searchsorted(kept, of) + np.arange(len(of))  # an end for each text before
    long = kept[size[kept] > LONGEST]
    source = np.arange(len(found))
    source[long] = len(found) + 1 + np.arange(len(long))
    take = np.full(len(kept) + len(texts), len(found))
    words = np.ones(len(take), bool)
    words[first[1:] - 1] = False
    take[words] = source[kept]
    added = pa.array([END, *map(_digest, found.take(pa.array(long)).to_pylist())], pa.large_binary())
    return pa.concat_arrays([found, added]).take(pa.array(take)), first


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The bytes of values[first[i] : first[i + 1]] for each i."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents, all of them; tasks sum before the shuffle."""
    source = docs.where(fold("doc_id", FOLDS) != HELD).select(text_or_empty("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pa.table({"word": pa.array([], pa.large_binary()), "c": pa.array([], pa.int64())})
        parts, held = [counts], 0

        def summed() -> pa.Table:
            found = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return found.select(["word", "c_sum"]).rename_columns(["word", "c"])

        def flush(found: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.table([found.column("word").cast(pa.binary()), found.column("c")], names=["word", "c"]).to_batches()

        for batch in pieces(batches, "_text", TEXT_BYTES, 4096):
            met = pc.value_counts(tokens_of(batch.column("_text"))[0])
            parts.append(pa.table([met.field("values"), met.field("counts")], names=["word", "c"]))
            held += len(met)
            if held > HELD_WORDS:
                parts, held = [found := summed()], len(found)
                if 2 * held > HELD_WORDS:
                    yield from flush(found)
                    parts, held = [counts], 0
        yield from flush(summed())

    return source.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Alphabet:
    """What a task needs to turn words into symbols. Symbols: the frequent words from 0, then the classes."""

    known: dict[bytes, tuple[int, int]]  # frequent word -> (symbol, count)
    total: int  # training tokens
    distinct: int
    class_log: np.ndarray  # log10 of (tokens + distinct words + 1) of each class among infrequent words
    mass: np.ndarray = field(default=None)  # training tokens of each symbol

    @property
    def size(self) -> int:
        return len(self.known) + CLASSES


def alphabet(counts: DataFrame, words: int = WORDS) -> Alphabet:
    """The frequent words are those above the least count bucket at which at most `words` of them remain.

    Where the highest bucket alone has more, no word is frequent: each then holds a small share of the corpus, and all
    of them meet their counts by a join.
    """
    step = F.floor(F.log2("c") * 16)
    sums = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in sums), sum(r.n for r in sums)
    least, have = None, 0
    for r in sorted(sums, key=lambda r: -r.step):
        if (have := have + r.n) > words:
            break
        least = r.step
    frequent = step >= least if least is not None else F.lit(False)
    known = {bytes(r.word): (k, r.c) for k, r in enumerate(sorted(counts.where(frequent).collect(), key=lambda r: (-r.c, bytes(r.word))))}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 2), np.int64)
        for batch in batches:
            which = np.array([_class(w.as_py()) for w in batch.column("word")], int)
            sums[:, 0] += np.bincount(which, batch.column("c").to_numpy(), CLASSES).astype(np.int64)
            sums[:, 1] += np.bincount(which, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["k", "c", "n"])

    rest = counts.where(~frequent).mapInArrow(classes, "k long, c long, n long").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    share = np.zeros((CLASSES, 2))
    for r in rest.collect():
        share[r.k] = r.c, r.n
    mass = np.concatenate([[float(c) for _, c in known.values()], share[:, 0]])
    return Alphabet(known, total, distinct, np.log10(share.sum(1) + 1), mass)


@dataclass
class Hmm:
    start: np.ndarray  # (K)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (symbols, K)

    @classmethod
    def first(cls, mass: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """Unigram shares, pulled apart by seeded noise; states that tend to stay."""
        noise = np.random.default_rng(seed).gamma(1.0, 1.0, (len(mass), states))
        emit = (mass[:, None] + 0.5) * (0.2 + noise)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Hmm:
        """From expected counts, smoothed towards equal starts and moves and the unigram."""
        share = (mass + 0.5) / (mass + 0.5).sum()
        start = start + 1.0
        move = move + 1.0
        emit = emit + 50.0 * share[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _packed(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, n, flat): texts by falling length; at step t the first n[t] of them stand; flat holds step after step."""
    lengths = np.array([len(s) for s in symbols])
    order = np.argsort(-lengths, kind="stable")
    n = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    base = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(base[-1], np.int64)
    for rank, k in enumerate(order.tolist()):
        flat[base[: lengths[k]] + rank] = symbols[k]
    return order, n, flat


def _stretches(at: list[int], held: int) -> list[tuple[int, int]]:
    """(first, last) steps of stretches of about `held` tokens, one step at least."""
    edges = [0]
    for t in range(len(at) - 1):
        if at[t + 1] - at[edges[-1]] > held and t > edges[-1]:
            edges.append(t)
    edges.append(len(at) - 1)
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(at) > 1 else []


def _room(width: int, at: list[int], stretches: list[tuple[int, int]], n: int) -> list[np.ndarray]:
    """n flat arrays that hold the states of any of the stretches; memory that is got anew for each costs as much as the sums."""
    return [np.empty(width * max((at[last] - at[first] for first, last in stretches), default=0)) for _ in range(n)]


def _ahead(model: Hmm, seen: np.ndarray, alpha: np.ndarray, at: list[int], first: int, last: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(states of the steps first to last, whose emissions are seen, in alpha's memory; scales); state: that of the step before.

    Has a row for each state, so that what is done to all texts of a step runs along memory. Every SCALED-th step is
    scaled to sum to 1; the scales of the others are 1.
    """
    base, width = at[first], len(model.start)
    alpha, scale = alpha[: seen.size].reshape(seen.shape), np.ones(seen.shape[1])
    moved, turn = np.empty(width * max(at[t + 1] - at[t] for t in range(first, last))), model.move.T.copy()
    for t in range(first, last):
        a, b = at[t] - base, at[t + 1] - base
        now = moved[: width * (b - a)].reshape(width, b - a)
        if state is None:
            now[:] = model.start[:, None]
        else:
            np.matmul(turn, state[:, : b - a], out=now)
        state = np.multiply(now, seen[:, a:b], out=alpha[:, a:b])
        if t % SCALED == SCALED - 1:
            state /= np.add.reduce(state, 0, out=scale[a:b])
    return alpha, scale


def _ends(n: np.ndarray, at: list[int], first: int, last: int) -> np.ndarray:
    """Places of the texts that end in the steps first to last, counted from the first."""
    after = np.append(n[first + 1 :], 0)[: last - first]
    ended = n[first:last] - after
    starts = np.array(at[first:last]) - at[first] + after
    return np.repeat(starts - np.cumsum(ended) + ended, ended) + np.arange(ended.sum())


def forward(model: Hmm, symbols: list[np.ndarray], own: list[np.ndarray] | None = None, times: np.ndarray | None = None, held: int = HELD_TOKENS) -> np.ndarray:
    """log10 probability of each symbol sequence: the scaled forward recursion, all texts abreast.

    own: for each symbol the row of times that its emissions are multiplied by, -1 for none. Only the states of about
    `held` tokens are held.
    """
    order, n, flat = _packed(symbols)
    which = _packed(own)[2] if own is not None else None
    at = np.concatenate([[0], np.cumsum(n)]).tolist()
    out, state = np.zeros(len(symbols)), None
    emissions, width, stretches = model.emit.T.copy(), len(model.start), _stretches(at, held)
    room = _room(width, at, stretches, 2)
    for first, last in stretches:
        part = slice(at[first], at[last])
        size = at[last] - at[first]
        seen = emissions.take(flat[part], 1, out=room[0][: width * size].reshape(width, size), mode="clip")
        if which is not None:
            odd = np.flatnonzero(which[part] >= 0)
            for row, factor in zip(seen, times[which[part][odd]].T, strict=True):
                row[odd] *= factor
        alpha, scale = _ahead(model, seen, room[1], at, first, last, state)
        ends = _ends(n, at, first, last)
        scale[ends] *= alpha[:, ends].sum(0)
        told = np.flatnonzero(scale != 1)
        step = np.searchsorted(np.array(at[first:last]) - at[first], told, "right") - 1
        text = told - (np.array(at[first:last]) - at[first])[step]
        out += np.bincount(text, np.log10(scale[told]), len(out))
        state = alpha[:, at[last - 1] - at[first] :].copy()
    back = np.empty(len(symbols))
    back[order] = out
    return back


def expected(
    model: Hmm, symbols: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray, np.ndarray], own: list[np.ndarray] | None = None, rows: np.ndarray | None = None, held: int = HELD_TOKENS
) -> float:
    """Adds the expected starts, moves and emissions of the sequences to counts; the log10 likelihood.

    own: for each symbol the row of rows that its states are added to as well, -1 for none. Only the states of about
    `held` tokens are held: of longer sequences the states at some steps are kept, and those between are made again.
    """
    order, n, flat = _packed(symbols)
    which = _packed(own)[2] if own is not None else None
    start, move, emit = counts
    at = np.concatenate([[0], np.cumsum(n)]).tolist()
    stretches = _stretches(at, held)
    entry: list[np.ndarray | None] = [None]
    emissions, width = model.emit.T.copy(), len(model.start)
    room = _room(width, at, stretches, 3)

    def states(first: int, last: int, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = at[last] - at[first]
        seen = emissions.take(flat[at[first] : at[last]], 1, out=room[0][: width * size].reshape(width, size), mode="clip")
        return seen, *_ahead(model, seen, room[1], at, first, last, state)

    for first, last in stretches[:-1]:
        _, alpha, _ = states(first, last, entry[-1])
        entry.append(alpha[:, at[last - 1] - at[first] :].copy())
    likelihood = 0.0
    carry = np.zeros((width, 0))  # what the next stretch says of the texts that go on in it
    for (first, last), state in zip(reversed(stretches), reversed(entry), strict=True):
        base, part = at[first], slice(at[first], at[last])
        seen, alpha, scale = states(first, last, state)
        beta = room[2][: seen.size].reshape(seen.shape)
        ends = _ends(n, at, first, last)
        whole = alpha[:, ends].sum(0)
        beta[:, ends] = 1 / whole
        beta[:, at[last - 1] - base :][:, : carry.shape[1]] = carry
        told = np.flatnonzero(scale != 1)
        likelihood += float(np.log10(scale[told]).sum() + np.log10(whole).sum())
        for t in range(last - 1, first, -1):
            a, b = at[t] - base, at[t + 1] - base
            back = seen[:, a:b]
            back *= beta[:, a:b]
            if t % SCALED == SCALED - 1:
                back /= scale[a:b]
            before = at[t - 1] - base
            np.matmul(model.move, back, out=beta[:, before : before + b - a])
        head = slice(0, at[first + 1] - base)
        seen[:, head] *= beta[:, head] / scale[head]
        if state is not None:
            carry = model.move @ seen[:, head]
            move += state[:, : carry.shape[1]] @ seen[:, head].T
        # a text's place one step before: the steps between are as wide as that step
        later = np.arange(head.stop, len(scale))
        move += alpha.take(later - np.repeat(n[first : last - 1], n[first + 1 : last]), 1) @ seen[:, head.stop :].T
        alpha *= beta
        if not first:
            start += alpha[:, head].sum(1)
        for k in range(width):
            emit[:, k] += np.bincount(flat[part], alpha[k], len(emit))
        if which is not None:
            odd = np.flatnonzero(which[part] >= 0)
            met, place = np.unique(which[part][odd], return_inverse=True)
            rows[met] += np.array([np.bincount(place, a[odd], len(met)) for a in alpha]).T
    return likelihood


def encode(docs: DataFrame, letters: Alphabet, keep: list[str]) -> DataFrame:
    """keep, n_tokens, symbols (16-bit, little-endian), odd (32-bit), words (infrequent ones, each once), log_known, log_class, n_known.

    odd holds for each token that is an infrequent word, in order, its place in words.
    log_known is the sum over tokens with symbols of their own of log10(count + 1); log_class that of the others'
    class denominators; n_known counts the tokens with symbols of their own.
    """
    source = docs.select(*keep, text_or_empty("text").cast("binary").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(letters)
    more = "n_tokens long, symbols binary, odd binary, words array<binary>, log_known double, log_class double, n_known long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = pa.array(list(shared.value.known), pa.large_binary()), len(shared.value.known)
        # what a symbol adds to the sums: a frequent word to one, a class to the other
        logs = np.concatenate([np.log10(shared.value.mass[:first] + 1), shared.value.class_log])
        for batch in pieces(batches, "_text", TEXT_BYTES, 4096):
            words, at = tokens_of(batch.column("_text"))
            symbols = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            odd = np.flatnonzero(symbols < 0)
            rare = words.take(pa.array(odd)).dictionary_encode()
            codes, kinds = rare.indices.to_numpy(zero_copy_only=False), np.array([_class(w) for w in rare.dictionary.to_pylist()], np.int64)
            symbols[odd] = first + kinds[codes]
            weight, is_known = logs[symbols], symbols < first
            log_known, log_class = (np.add.reduceat(np.where(m, weight, 0.0), at[:-1]) for m in (is_known, ~is_known))
            odd_at = np.searchsorted(odd, at)
            text = np.repeat(np.arange(len(at) - 1), np.diff(odd_at))
            own, place = np.unique(text * len(kinds) + codes, return_inverse=True)  # each text's infrequent words
            own_at = np.searchsorted(own, np.arange(len(at)) * len(kinds))
            n_tokens, n_odd = np.diff(at), np.diff(odd_at)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep), pa.array(n_tokens), _binary(symbols.astype("<u2"), at), _binary((place - own_at[text]).astype("<u4"), odd_at),
                    list_array(rare.dictionary.take(pa.array(own % max(1, len(kinds)))).cast(pa.binary()), np.diff(own_at)), pa.array(log_known), pa.array(log_class), pa.array(n_tokens - n_odd),
                ],
                names=[*keep, *(f.split()[0] for f in more.split(", "))],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("_text").schema)
    return source.mapInArrow(run, f"{fields}, {more}" if fields else more)


def _counted(part: DataFrame, letters: Alphabet, model: Hmm) -> tuple[np.ndarray, float]:
    """(rows of start, moves and symbols, log10 likelihood) of the expected counts over part (symbols).

    Tasks sum before the shuffle; the driver gets the sums, whose size is bounded by the alphabet.
    """
    states, size = len(model.start), letters.size
    shared = part.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        likelihood = np.zeros((1, states))
        for batch in pieces(batches, "symbols", ABREAST, 8192):
            likelihood[0, 0] += expected(shared.value, [np.frombuffer(s.as_py(), "<u2") for s in batch.column("symbols")], counts)
        start, move, emit = counts
        whole = np.vstack([start[None], move * shared.value.move, emit, likelihood])
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(whole[used, k]) for k in range(states))], names=["row", *(f"n{k}" for k in range(states))])

    columns = [f"n{k}" for k in range(states)]
    part = part.select("symbols").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns))
    sums = part.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    shared.destroy()
    whole = np.zeros((2 + states + size, states))
    whole[sums.column("row").to_numpy()] = np.array([sums.column(c).to_numpy() for c in columns]).T
    return whole[:-1], float(whole[-1, 0])


def train(encoded: DataFrame, letters: Alphabet, states: int = STATES, passes: int = PASSES) -> tuple[Hmm, list[float]]:
    """(model, log10 likelihood of the training documents before each full pass) by Baum-Welch.

    First each training fold once, its counts blended into those so far: this tells the states apart. Then passes - 1
    times all training folds together, with equal weights; the caller's count_states is the last pass.
    """
    model, sums, seen = Hmm.first(letters.mass, states), None, []
    for step, k in enumerate(k for k in range(FOLDS) if k != HELD):
        whole, _ = _counted(encoded.where(F.col("_fold") == k), letters, model)
        if not whole.any():
            continue
        rate = (step + 1) ** -0.6
        sums = whole if sums is None else (1 - rate) * sums + rate * whole
        model = Hmm.of(sums[0], sums[1 : 1 + states], sums[1 + states :], letters.mass)
    for _ in range(passes - 1 if sums is not None else 0):
        whole, likelihood = _counted(encoded.where(F.col("_fold") != HELD), letters, model)
        model = Hmm.of(whole[0], whole[1 : 1 + states], whole[1 + states :], letters.mass)
        seen.append(likelihood)
    return model, seen


def _own(symbols: list[np.ndarray], odd: pa.Array, first: int, numbers: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the number of each symbol's word, -1 for frequent words; numbers: of each text's infrequent words."""
    out = []
    for s, o, n in zip(symbols, odd, numbers, strict=True):
        which = np.full(len(s), -1)
        which[s >= first] = n[np.frombuffer(o.as_py(), "<u4")]
        out.append(which)
    return out


def count_states(encoded: DataFrame, letters: Alphabet, model: Hmm) -> DataFrame:
    """(row, word, c, n): tokens and expected counts by state over all training documents, each with the same weight.

    row -1 has every infrequent training word; the others have no word and are start, moves and symbols, as in train().
    encoded: _fold, symbols, odd and words. The words' rows grow with the corpus and stay distributed.
    """
    states, size, first = len(model.start), letters.size, len(letters.known)
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def batch_of(rows: pa.Array, words: pa.Array, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        flat = pa.FixedSizeListArray.from_arrays(pa.array(n.ravel().astype(np.float32)), states).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([rows, words, pa.array(c, pa.int64()), flat], names=["row", "word", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        number: dict[bytes, int] = {}
        rows, met = np.zeros((0, states)), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            out = batch_of(pa.array(np.full(len(number), -1)), pa.array(list(number), pa.binary()), met[: len(number)], rows[: len(number)])
            number.clear()
            return out

        for batch in pieces(batches, "symbols", ABREAST, 8192):
            symbols = [np.frombuffer(s.as_py(), "<u2") for s in batch.column("symbols")]
            numbers = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in batch.column("words").to_pylist()]
            if len(rows) < len(number):
                more = max(len(number), 2 * len(rows)) - len(rows)
                rows, met = np.vstack([rows, np.zeros((more, states))]), np.concatenate([met, np.zeros(more, np.int64)])
            own = _own(symbols, batch.column("odd"), first, numbers)
            expected(shared.value, symbols, counts, own, rows)
            met += np.bincount(np.concatenate(own) + 1, minlength=len(met) + 1)[1:]
            if len(number) > SUMMED:
                yield flush()
                rows, met = np.zeros((0, states)), np.zeros(0, np.int64)
        yield flush()
        start, move, emit = counts
        whole = np.vstack([start[None], move * shared.value.move, emit])
        used = np.flatnonzero(whole.any(1))
        yield batch_of(pa.array(used), pa.nulls(len(used), pa.binary()), np.zeros(len(used)), whole[used])

    part = encoded.where(F.col("_fold") != HELD).select("symbols", "odd", "words").mapInArrow(run, "row long, word binary, c long, n array<float>")
    # tasks have summed already: rows are dealt out as they are and summed after
    sums = part.repartition("row", "word").groupBy("row", "word").agg(F.sum("c").alias("c"), *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(states)])
    return sums.select("row", "word", "c", F.array(*[F.col(f"n{i}").cast("float") for i in range(states)]).alias("n"))


def collected(counted: DataFrame, letters: Alphabet, states: int) -> np.ndarray:
    """Rows of start, moves and symbols of count_states(); their number is bounded by the alphabet."""
    whole = np.zeros((1 + states + letters.size, states))
    for r in counted.where("row >= 0").select("row", "n").collect():
        whole[r.row] = r.n
    return whole


def class_shares(whole: np.ndarray, letters: Alphabet) -> np.ndarray:
    """Of each class's training tokens the share in each state, each FLOOR at least."""
    counts = whole[len(whole) - CLASSES :]
    total = counts.sum(1, keepdims=True)
    return np.where(total > 0, counts / np.maximum(total, 1e-300), 1.0) + FLOOR


def own_times(n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What a word of a class, by its expected counts n, multiplies the class's emissions by, over the class's add-one total.

    The counts in each state over the class's share in it, and one more: 1 for an unseen word, and c + 1 in each state for
    a word met c times that is spread like its class. The sum over a class's words in each state is its add-one total.
    """
    return (n + FLOOR * n.sum(1, keepdims=True)) / share + 1.0


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that nothing refers to any more, here or in its JVM."""
    gc.collect()
    spark._jvm.System.gc()


def own_dtype(states: int) -> np.dtype:
    return np.dtype([("c", "<i8"), ("times", "<f4", (states,))])


def word_emissions(counted: DataFrame, letters: Alphabet, share: np.ndarray) -> DataFrame:
    """(word, e) of the infrequent training words: e holds the word's count and, for each state, what it multiplies its class's emissions by.

    The count is a 64-bit integer, the others are 32-bit, as in own_dtype(); a pair of document and word carries just one value.
    """
    states = share.shape[1]
    shared = counted.sparkSession.sparkContext.broadcast(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            kinds = np.array([_class(w.as_py()) for w in words], np.int64)
            n = batch.column("n").flatten().to_numpy().reshape(-1, states)
            e = np.empty(len(words), own_dtype(states))
            e["c"], e["times"] = batch.column("c").to_numpy(), own_times(n, shared.value[kinds])
            yield pa.RecordBatch.from_arrays([words, _binary(e, np.arange(len(e) + 1))], names=["word", "e"])

    return counted.where("row = -1").select("word", "c", "n").mapInArrow(run, "word binary, e binary")


def score_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), states: int = STATES, words: int = WORDS, passes: int = PASSES) -> DataFrame:
    """keep, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs.

    Learns from the documents whose fold is not HELD. base_score sums log10((c + 1) / (N + V + 1)); score is the hidden
    Markov model's log10 probability of the whole text, each training word by its own emissions. A null text is empty:
    its only token is the end. With no training documents N and V are 0 and every word is unseen.
    """
    tables = SharedTables(docs.sparkSession)
    names = list(dict.fromkeys(keep))
    counts = tables.write(count_words(docs), "counts")
    letters = alphabet(counts, words)
    tables.drop(counts)
    free_shuffles(docs.sparkSession)
    marked = docs.select("text", F.struct(*names).alias("_keep"), fold("doc_id", FOLDS).cast("int").alias("_fold"), F.monotonically_increasing_id().alias("_row"))
    # a folder per fold: a pass reads the folds that it counts
    encoded = tables.write(encode(marked, letters, ["_keep", "_fold", "_row"]), "encoded", by="_fold")
    model, _ = train(encoded, letters, states, passes)
    counted = tables.write(count_states(encoded, letters, model), "states")
    free_shuffles(docs.sparkSession)
    sums = collected(counted, letters, states)
    model, share = Hmm.of(sums[0], sums[1 : 1 + states], sums[1 + states :], letters.mass), class_shares(sums, letters)

    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = len(letters.known)

    def run(texts: pa.Table, met: pa.Table) -> pa.Table:
        # a text's infrequent words: its row in the block, their places and what they have, by both
        at = met.column("at").to_numpy()
        by = np.argsort(at)
        at, own = at[by], np.frombuffer(byte_view(met.column("e"))[0], own_dtype(states))[by]
        out = []
        for batch in pieces(texts.to_batches(), "symbols", ABREAST, 8192):
            symbols = [np.frombuffer(s.as_py(), "<u2") for s in batch.column("symbols")]
            row = (batch.column("_row").to_numpy() & (BLOCK - 1)) << 32
            of, to = np.searchsorted(at, row).tolist(), np.searchsorted(at, row + (1 << 32)).tolist()
            numbers, logs, known = [], [], []
            for k, o in enumerate(batch.column("odd")):
                tally = np.bincount(np.frombuffer(o.as_py(), "<u4"))
                here = slice(of[k], to[k])
                place = at[here] & 0xFFFFFFFF
                number = np.full(len(tally), -1)
                number[place] = np.arange(of[k], to[k])
                numbers.append(number)
                logs.append(float((tally[place] * np.log10(own["c"][here] + 1)).sum()))
                known.append(int(tally[place].sum()))
            found = forward(shared.value, symbols, _own(symbols, batch.column("odd"), first, numbers), own["times"])
            kept = [batch.column(c) for c in columns]
            out.append(pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array(logs), pa.array(known, pa.int64())], names=[*columns, "_path", "_log", "_times"]))
        return pa.Table.from_batches(out)

    own = tables.write(word_emissions(counted, letters, share), "own")
    tables.drop(counted)
    columns = ["_keep", "_fold", "n_tokens", "log_known", "log_class", "n_known"]
    block = F.expr(f"_row div {BLOCK}").alias("_block")

    def scored(part: DataFrame) -> DataFrame:
        # infrequent words meet their counts and states: no word of them holds more than a bounded share of the corpus
        place = (F.expr(f"_row % {BLOCK}") * F.lit(1 << 32) + F.col("at")).alias("at")
        rare = part.select("_row", F.posexplode("words").alias("at", "word")).select(block, place, "word")
        rare = rare.join(own.hint("shuffle_hash"), "word").select("_block", "at", "e")
        like = part.select(*columns, F.lit(0.0).alias("_path"), F.lit(0.0).alias("_log"), F.lit(0).cast("long").alias("_times"))
        whole = part.select(block, "_row", *columns, "symbols", "odd")
        return whole.groupBy("_block").cogroup(rare.groupBy("_block")).applyInArrow(run, like.schema)

    lots = []
    for lot in LOTS:
        free_shuffles(docs.sparkSession)
        lots.append(tables.write(scored(encoded.where(F.col("_fold").isin(*lot))), "scores"))
    tables.drop(encoded, own)
    scored_all = reduce(DataFrame.union, lots)
    floor = float(np.log10(letters.total + letters.distinct + 1))
    return scored_all.select(
        *[F.col("_keep")[c].alias(c) for c in names],
        (F.col("_fold") == HELD).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("_times")).alias("n_known"),
        F.lit(letters.total).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.col("_log") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("_path") - F.col("log_class")).alias("score"),
    )
