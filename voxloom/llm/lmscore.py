"""Scoring texts with a small causal self-attention model trained in numpy on subword ids, beside a word unigram.

A text is the subword ids of its words, each encoded with the space before it, and one end. Ids are scored in windows: a window
scores ``SPAN`` consecutive ids and sees the ``SPAN`` before them, whatever words they belong to, so windows overlap, each id is
scored once and sees between ``SPAN`` and ``2 * SPAN - 1`` earlier ids of its text (all of them near its beginning). Masked
attention runs over batches of windows; distances have learned weights, and the two ids before an input are added to it.

The next id comes from a softmax in two levels, over 32 groups and 32 leaves of a group: the commonest ids are leaves of
their own, the others share leaves by their training counts. That is a proper distribution over texts.

Everything that is counted is counted over all training documents with grouped sums. Training is distributed and reads every
training id once: pieces of texts are dealt to hands by a hash; every task takes gradient steps over its hand from shared
parameters, which are averaged by the ids that they saw, and a second round goes on from there with the other pieces.
"""

from __future__ import annotations

import base64
import ctypes
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.llm.common import materialize, read, short_batches
from voxloom.llm.packing import ranks_encoder, vocabulary

#: Ids of the vocabulary, and the id at a text's end, which also stands before a text.
IDS, END = 50_257, 50_256
#: Groups of leaves, leaves of a group, ids that are a leaf of their own, and buckets of ids that tell what company an id keeps.
GROUPS, LEAVES, SINGLES, COMPANY = 32, 32, 960, 48
ROWS = GROUPS * LEAVES
#: Ids that a window scores, and as many before them that it sees; width and hidden width.
SPAN, WIDTH, HIDDEN = 16, 16, 48
#: Ids of a piece of a text in training, a whole number of windows; windows of a step, at least; windows of a batch in scoring.
PIECE, STEP, CHUNK = 4096, 512, 512
#: Ids of a hand, a random share of all pieces that one task learns from.
HAND = 4_000_000
#: Words whose count a scoring task holds; rarer ones are joined.
FREQUENT = 250_000
_MEMO, _FLUSH, _MANY = 500_000, 600_000, 100_000


def keep_memory() -> None:
    """Let this process's allocator (glibc's) hand freed arrays on to the next ones. A fresh process maps the arrays of every step anew,
    with faults on their pages; one that freed larger arrays before has learnt to keep some."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD: the largest that it takes
    mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def word_openers(path: str) -> np.ndarray:
    """Which ids start with a space; the end is one of them."""
    opens = np.zeros(IDS, bool)
    opens[END] = True
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            opens[int(rank)] = base64.b64decode(token).startswith(b" ")
    return opens


class Subwords:
    """Ids of words, each with the space before it; strings of special tokens are ordinary text, and the empty word is the end.

    Many words are encoded together: the vocabulary's pattern never joins what a space separates, so the bytes of the ids
    tell where each word ends. Where they don't, next to white space that isn't ASCII, words are encoded one by one.
    """

    def __init__(self, path: str):
        self.encode, self.size = ranks_encoder(path, {}), np.zeros(IDS, np.int64)
        with open(path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                self.size[int(rank)] = len(base64.b64decode(token))

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids, one after the other, and how many each has."""
        some = [w for w in words if w]
        ids = self.encode(" " + b" ".join(some).decode()).astype(np.int64) if some else np.zeros(0, np.int64)
        width = np.fromiter(map(len, words), np.int64, len(words))
        empty = width == 0
        width += ~empty
        at, bytes_ = np.cumsum(width), np.concatenate([[0], np.cumsum(self.size[ids])])
        upto = np.searchsorted(bytes_, at)
        if (bytes_[upto] != at).any():
            alone = [self.encode(" " + w.decode()).astype(np.int64) if w else np.zeros(0, np.int64) for w in words]
            ids, upto = np.concatenate(alone), np.cumsum(list(map(len, alone)))
        return np.insert(ids, upto[empty], END), np.diff(upto, prepend=0) + empty


class Lexicon:
    """Numbers of the words that a task has met and their ids; begun anew when it holds too many."""

    def __init__(self, path: str):
        self.subwords = Subwords(path)
        self.clear()

    def clear(self) -> None:
        self.number, self.words = {}, []
        self.ids, self.first, self.size = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """The numbers of ``words``; new ones follow those known before, of which there were so many."""
        known = len(self.words)
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(at < 0).tolist()
        if lost:
            fresh = list(dict.fromkeys(words[k] for k in lost))
            self.number.update(zip(fresh, range(known, known + len(fresh))))
            ids, size = self.subwords.each(fresh)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
            self.ids, self.size = np.concatenate([self.ids, ids.astype(np.uint16)]), np.concatenate([self.size, size])
            self.words += fresh
            at[lost] = [self.number[words[k]] for k in lost]
        return at, known

    def spelled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with numbers ``at``, one after the other, and where each ends."""
        size = self.size[at]
        ends = np.cumsum(size)
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.first[at] - ends + size, size)], ends


def texts_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, A-Z in lower case and split at ASCII white space; the place among them of each text's words, followed
    by the empty word's; and the number of each text's words, that one too."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words = found.flatten().dictionary_encode()
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.binary())), b" ")[0].as_py()  # no word has a space
    distinct, at = whole.split(b" "), words.indices.to_numpy()
    end = distinct.index(b"") if b"" in distinct else len(distinct)
    distinct += [b""] * (end == len(distinct))
    full = at != end  # next to a text's rims there are empty words
    n = np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])])
    return distinct, np.insert(at[full], np.cumsum(n), end), n + 1


def pieces_of(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text's pieces in training: how many of their first ids are only seen, and their sequence as :func:`blocks_of` takes it."""
    whole = np.concatenate([np.full(3, END, np.uint16), ids])
    for at in range(0, len(ids), PIECE):
        skip = min(at, SPAN)
        yield skip, whole[at - skip : at + PIECE + 3]


_READ = pa.schema([("word", pa.string()), ("c", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("piece", pa.int64()), ("skip", pa.int32()), ("size", pa.int64()), ("ids", pa.binary())])


def _read_texts(path: str):
    """Words with their counts, and pieces of texts with their ids; other columns are null. What is held is flushed as it grows."""

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _READ], schema=_READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        lexicon, counts = Lexicon(path), np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            found = table(word=pa.array(lexicon.words, pa.binary()).cast(pa.string()), c=counts)
            lexicon.clear()
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            words, at, n = texts_of(batch.column("text"))
            at = lexicon.numbers(words)[0][at]
            more = np.bincount(at, minlength=len(lexicon.words))
            more[: len(counts)] += counts
            counts = more
            ids, ends = lexicon.spelled(at)
            texts = np.split(ids, ends[np.cumsum(n) - 1][:-1])
            out = [(i, row, k, skip, len(s) - 3 - skip, s.tobytes()) for i, row, text in zip(batch.column("id").to_pylist(), batch.column("row").to_pylist(), texts, strict=True) for k, (skip, s) in enumerate(pieces_of(text))]
            yield table(**dict(zip(("id", "row", "piece", "skip", "size", "ids"), zip(*out), strict=True)))
            if len(counts) > _FLUSH:
                yield flush()
                counts = np.zeros(0, np.int64)
        if len(counts):
            yield flush()

    return run


def small_rows(df: DataFrame) -> DataFrame:
    """Long Arrow batches for what follows: rows are words, not texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    return df


def _by_words(path: str):
    """Sums over the words table: how often each id occurs, and how often within eight places of another id of its word that is of
    each of ``COMPANY`` buckets; keys below ``IDS`` are the former."""

    def add(ids: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        word, bucket = np.repeat(np.arange(len(lengths)), lengths), ids * 40_503 % 65_521 % COMPANY
        keys, weights = [ids], [counts[word]]
        for step in range(1, 9):
            same = np.flatnonzero(word[step:] == word[:-step]) if len(word) > step else np.zeros(0, np.int64)
            for one, other in ((same, same + step), (same + step, same)):
                keys.append(IDS + ids[one] * COMPANY + bucket[other])
                weights.append(counts[word[one]])
        return np.bincount(np.concatenate(keys), np.concatenate(weights), IDS * (COMPANY + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, total = Subwords(path), np.zeros(IDS * (COMPANY + 1))
        words, counts = [], []

        def flush() -> None:
            total[:] += add(*subwords.each(words), np.array(counts, np.float64))
            words.clear()
            counts.clear()

        for batch in batches:
            words += map(str.encode, batch.column("word").to_pylist())
            counts += batch.column("c").to_pylist()
            if len(words) > _MANY:
                flush()
        if words:
            flush()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used].astype(np.int64), pa.int64())], names=["key", "c"])

    return run


def id_counts(words: DataFrame, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of ids and of their company, of which there are as many as the vocabulary fixes."""
    sums = small_rows(words).mapInArrow(_by_words(path), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(IDS * (COMPANY + 1))
    out[sums["key"].to_numpy("int64")] = sums["c"].to_numpy("float64")
    return out[:IDS], out[IDS:]


def near_centres(profile: np.ndarray, mass: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by the angle between rows of ``profile``, from rows that lie far apart; the number of each row's centre."""
    unit = profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    picked, close = [int(mass.argmax())], np.full(len(unit), -1.0)
    while len(picked) < k:
        close = np.maximum(close, unit @ unit[picked[-1]])
        picked.append(int(((1 - close) * mass).argmax()))
    centres, near = unit[picked].copy(), np.zeros(len(unit), np.int64)
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        for g in np.unique(near):
            centre = (unit[near == g] * mass[near == g, None]).sum(0)
            centres[g] = centre / max(np.linalg.norm(centre), 1e-9)
    return near


@dataclass
class Classes:
    """Leaf of each id, log10 of its share in its leaf, and log masses of groups and of leaves in their groups."""

    of: np.ndarray
    share: np.ndarray
    groups: np.ndarray
    leaves: np.ndarray


def make_classes(counts: np.ndarray, company: np.ndarray, order: np.ndarray, opens: np.ndarray) -> Classes:
    """The commonest ids are leaves of their own; the others are put together by the company they keep, apart for ids that
    open a word (``opens``) and ids that go on with one. Leaves are halved five times along the widest direction of
    their profiles, which gives the groups.
    """
    profile = np.log1p(company.reshape(IDS, COMPANY))
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    profile = np.hstack([profile, opens[:, None]])
    smooth, leaf = counts + 0.5, np.empty(IDS, np.int64)
    leaf[order[:SINGLES]] = np.arange(SINGLES)
    rest, half = order[SINGLES:], (GROUPS * LEAVES - SINGLES) // 2
    for side, ids in enumerate((rest[opens[rest]], rest[~opens[rest]])):
        leaf[ids] = SINGLES + side * half + near_centres(profile[ids], smooth[ids], half)
    n = GROUPS * LEAVES
    mass = np.bincount(leaf, smooth, n)
    centre = np.stack([np.bincount(leaf, smooth * profile[:, k], n) for k in range(profile.shape[1])], axis=1) / np.maximum(mass, 1e-9)[:, None]
    parts = [np.arange(n)]
    while len(parts) < GROUPS:
        halves = []
        for part in parts:
            x = centre[part] - centre[part].mean(0)
            along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
            part = part[np.argsort(along, kind="stable")]
            halves += [part[: len(part) // 2], part[len(part) // 2 :]]
        parts = halves
    place = np.empty(n, np.int64)
    place[np.concatenate(parts)] = np.arange(n)
    of, mass = place[leaf], mass[np.concatenate(parts)]
    mass = np.maximum(mass, 0.5)
    group = mass.reshape(GROUPS, LEAVES).sum(1)
    return Classes(of, np.log10(smooth / mass[of]), np.log(group / group.sum()), np.log(mass.reshape(GROUPS, LEAVES) / group[:, None]))


SEEN = 2 * SPAN
_SHAPES = {
    "emb": (ROWS, WIDTH), "one": (ROWS, WIDTH), "two": (ROWS, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "wo": (WIDTH, WIDTH), "near": (SEEN,),
    "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "out": (WIDTH, GROUPS), "bias": (GROUPS,), "leaf": (GROUPS, WIDTH, LEAVES), "leaf_bias": (GROUPS, LEAVES),
}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        found[name] = flat[at : at + n].reshape(shape)
        at += n
    return found


def first_parameters(classes: Classes, seed: int = 7) -> np.ndarray:
    """Small random weights; the biases are log frequencies, so that training starts at the unigram of ids."""
    rng = np.random.default_rng(seed)
    size = {"emb": 0.3, "one": 0.2, "two": 0.1, "leaf": 0.1, "out": 0.1, "w2": 0.1}
    parts = {n: rng.normal(0, size.get(n, 0.25), s) for n, s in _SHAPES.items()} | {"near": np.zeros(SEEN), "b1": np.zeros(HIDDEN), "bias": classes.groups, "leaf_bias": classes.leaves}
    return np.concatenate([parts[n].ravel() for n in _SHAPES]).astype(np.float32)


@dataclass
class Blocks:
    """Blocks of ``SPAN`` places of sequences, in order. ``rows``: leaves of the inputs and of the two ids before each;
    ``target``: ids to predict, where ``mask`` holds; ``fresh``: whether no block of the same sequence is before it; ``owner``: the sequence."""

    rows: np.ndarray
    target: np.ndarray
    mask: np.ndarray
    fresh: np.ndarray
    owner: np.ndarray

    def part(self, a: int, b: int) -> Blocks:
        return Blocks(self.rows[:, a:b], self.target[a:b], self.mask[a:b], self.fresh[a:b], self.owner[a:b])


def blocks_of(ids: np.ndarray, sizes: np.ndarray, skip: np.ndarray, classes: Classes) -> Blocks:
    """Sequences lie one after the other in ``ids``, with lengths ``sizes``. Each begins with the three ids before its first
    target (ends, at the beginning of a text); its first ``skip`` targets are seen but not scored."""
    n, leaf = sizes - 3, classes.of[ids]
    count = -(-n // SPAN)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    local = number[:, None] * SPAN + np.arange(SPAN)
    at = (np.cumsum(sizes) - sizes)[owner, None] + np.minimum(local, n[owner, None] - 1)
    return Blocks(np.stack([leaf[at + 2], leaf[at + 1], leaf[at]]), ids[at + 3].astype(np.int64), (local < n[owner, None]) & (local >= skip[owner, None]), number == 0, owner)


def _back() -> np.ndarray:
    """How far back each place that a window sees lies from each that it scores."""
    return SPAN + np.arange(SPAN)[:, None] - np.arange(SEEN)[None, :]


def _scaled(p: dict[str, np.ndarray]) -> np.ndarray:
    """The weights of queries, keys and values, the former with attention's scale."""
    w = p["qkv"].copy()
    w[:, :WIDTH] *= w.dtype.type(WIDTH**-0.5)
    return w


def _qkv(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values of each block, as views."""
    z = z.reshape(-1, SPAN, 3 * WIDTH)
    return z[..., :WIDTH], z[..., WIDTH : 2 * WIDTH], z[..., 2 * WIDTH :]


def _with_before(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of each block after those of the one before it, which its window sees: overlapping views of ``z``, which has an
    empty block in front."""
    windows = np.lib.stride_tricks.as_strided(z, (len(z) // SPAN - 1, SEEN, 3 * WIDTH), (SPAN * z.strides[0], *z.strides), writeable=False)
    return windows[..., WIDTH : 2 * WIDTH], windows[..., 2 * WIDTH :]


def _to_blocks(d: np.ndarray, out: np.ndarray) -> None:
    """The adjoint of :func:`_with_before`, for keys or values."""
    np.add(d[:-1, SPAN:], d[1:, :SPAN], out=out[:-1])
    out[-1] = d[-1, SPAN:]


def forward(p: dict[str, np.ndarray], rows: np.ndarray, fresh: np.ndarray) -> tuple:
    """Attention (its weights before they are divided by their sum) and hidden states; all but the attention have a row for each input. The first block must be fresh or is not scored."""
    x = p["emb"].take(rows[0].ravel(), axis=0)
    x += p["one"].take(rows[1].ravel(), axis=0)
    x += p["two"].take(rows[2].ravel(), axis=0)
    z = np.empty((SPAN + len(x), 3 * WIDTH), x.dtype)
    z[:SPAN] = 0
    np.matmul(x, _scaled(p), out=z[SPAN:])
    q, (k, v), back = _qkv(z[SPAN:])[0], _with_before(z), _back()
    a = q @ k.transpose(0, 2, 1)
    np.exp(a, out=a)
    a *= np.where(back >= 0, np.exp(p["near"])[np.maximum(back, 0)], np.float32(0))
    a[fresh, :, :SPAN] = 0
    total = (a.reshape(-1, SEEN) @ np.ones(SEEN, a.dtype)).reshape(-1, SPAN, 1)
    o = a @ v
    o /= total
    o = o.reshape(-1, WIDTH)
    h1 = x + o @ p["wo"]
    u = h1 @ p["w1"]
    u += p["b1"]
    np.maximum(u, 0, out=u)
    return x, q, k, v, a, total, o, h1, u, h1 + u @ p["w2"]


def _by_group(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """The order of targets by group, their groups and places in that order, and each group's span."""
    group = (leaf // LEAVES).astype(np.int8)
    order = np.argsort(group, kind="stable")
    group = group[order]
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return order, group.astype(np.int64), leaf[order] % LEAVES, [(g, slice(a, b)) for g, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]


def _output_weights(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each group, the weights and the biases of all groups beside those of its leaves."""
    w, bias = np.empty((GROUPS, WIDTH, GROUPS + LEAVES), p["out"].dtype), np.empty((GROUPS, GROUPS + LEAVES), p["out"].dtype)
    w[:, :, :GROUPS], w[:, :, GROUPS:] = p["out"], p["leaf"]
    bias[:, :GROUPS], bias[:, GROUPS:] = p["bias"], p["leaf_bias"]
    return w, bias


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of ``z`` in its place, as two rows for each of its rows, and these rows' sums: there are as many groups as leaves of one."""
    np.exp(z, out=z)
    halves = z.reshape(-1, LEAVES)
    return halves, halves @ np.ones(LEAVES, z.dtype)


def log10_probabilities(p: dict[str, np.ndarray], b: Blocks, leaf: np.ndarray) -> np.ndarray:
    """log10 probability of the leaves ``leaf`` where the mask holds, and 0 elsewhere."""
    h, at, out = forward(p, b.rows, b.fresh)[-1], np.flatnonzero(b.mask), np.zeros(b.mask.shape)
    order, group, place, spans = _by_group(leaf.ravel()[at])
    at, (w, bias) = at[order], _output_weights(p)
    h, z = h.take(at, axis=0), np.empty((len(at), GROUPS + LEAVES), h.dtype)
    for g, span in spans:
        np.matmul(h[span], w[g], out=z[span])
        z[span] += bias[g]
    start = np.arange(len(at)) * (GROUPS + LEAVES)
    hit = z.ravel().take(start + group) + z.ravel().take(start + GROUPS + place)
    hit -= np.log(_exp(z)[1]).reshape(-1, 2).sum(1)
    out.ravel()[at] = hit / np.log(10)
    return out


def _output_gradient(p: dict[str, np.ndarray], g: dict[str, np.ndarray], h: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, float]:
    """The gradient of ``h``, of which rows ``at`` predict ``leaf``. A group's targets go through all steps together, while they are in the cache."""
    order, group, place, spans = _by_group(leaf)
    at, (w, bias) = at[order], _output_weights(p)
    out, h = np.zeros_like(h), h.take(at, axis=0)
    dw, db, dh, hit = np.zeros_like(w), np.zeros_like(bias), np.empty_like(h), np.empty((2, len(h)), h.dtype)
    for k, span in spans:
        z = h[span] @ w[k]
        z += bias[k]
        halves, sums = _exp(z)
        halves *= (1 / sums)[:, None]
        flat, to = z.ravel(), np.arange(GROUPS, z.size, GROUPS + LEAVES) + place[span]
        hit[0, span], hit[1, span] = z[:, k], flat.take(to)
        z[:, k] -= 1
        flat[to] = hit[1, span] - 1
        np.matmul(h[span].T, z, out=dw[k])
        np.matmul(np.ones(len(z), z.dtype), z, out=db[k])
        np.matmul(z, w[k].T, out=dh[span])
    g["out"] += dw[:, :, :GROUPS].sum(0)
    g["bias"] += db[:, :GROUPS].sum(0)
    g["leaf"] += dw[:, :, GROUPS:]
    g["leaf_bias"] += db[:, GROUPS:]
    out[at] = dh
    return out, -float(np.log(np.maximum(hit, 1e-30)).sum())


def _add_rows(to: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
    order = np.argsort(rows.astype(np.int16), kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    to[sorted_[first]] += np.add.reduceat(d.take(order, axis=0), first, axis=0)


def _hidden_gradient(p: dict[str, np.ndarray], g: dict[str, np.ndarray], rows: np.ndarray, held: tuple, dh: np.ndarray) -> None:
    x, q, k, v, a, total, o, h1, u, _ = held
    g["w2"] += u.T @ dh
    du = dh @ p["w2"].T
    du *= u > 0
    g["w1"] += h1.T @ du
    g["b1"] += du.sum(0)
    dh += du @ p["w1"].T
    do = (dh @ p["wo"].T).reshape(q.shape)
    g["wo"] += o.T @ dh
    d = np.empty((len(x), 3 * WIDTH), dh.dtype)
    dq, dk, dv = _qkv(d)
    do /= total
    _to_blocks(a.transpose(0, 2, 1) @ do, dv)
    da = do @ v.transpose(0, 2, 1)
    da -= ((do.reshape(-1, WIDTH) * o) @ np.ones(WIDTH, do.dtype)).reshape(*do.shape[:2], 1)
    da *= a
    back = _back()
    sums = (np.ones(len(da), da.dtype) @ da.reshape(len(da), -1)).reshape(back.shape)
    g["near"] += np.bincount(np.maximum(back, 0).ravel(), (sums * (back >= 0)).ravel(), SEEN).astype(dh.dtype)
    np.matmul(da, k, out=dq)
    _to_blocks(da.transpose(0, 2, 1) @ q, dk)
    dw = x.T @ d
    dw[:, :WIDTH] *= dh.dtype.type(WIDTH**-0.5)
    g["qkv"] += dw
    dh += d @ _scaled(p).T
    for name, each in zip(("emb", "one", "two"), rows, strict=True):
        _add_rows(g[name], each.ravel(), dh)


def gradient(p: dict[str, np.ndarray], b: Blocks, leaf: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the sum of cross entropies where the mask holds, and its value."""
    flat = np.zeros(sum(int(np.prod(s)) for s in _SHAPES.values()), p["emb"].dtype)
    g, held, at = unpack(flat), forward(p, b.rows, b.fresh), np.flatnonzero(b.mask)
    dh, loss = _output_gradient(p, g, held[-1], at, leaf.ravel()[at])
    _hidden_gradient(p, g, b.rows, held, dh)
    return flat, loss


class Trainer:
    """Adam over blocks; each id is learned from once."""

    def __init__(self, flat: np.ndarray, classes: Classes, rate: float):
        self.p, self.classes, self.rate = flat.copy(), classes, rate
        self.m, self.v, self.step, self.seen = np.zeros_like(flat), np.zeros_like(flat), 0, 0.0

    def learn(self, b: Blocks) -> float:
        """One step; the cross entropy before it."""
        g, loss = gradient(unpack(self.p), b, self.classes.of[b.target])
        n = float(b.mask.sum())
        g /= np.float32(max(n, 1.0))
        self.step, self.seen = self.step + 1, self.seen + n
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        rate = self.rate / (1 + self.step / 200) ** 0.5
        self.p -= np.float32(rate) * (self.m / np.float32(1 - 0.9**self.step)) / (np.sqrt(self.v / np.float32(1 - 0.99**self.step)) + np.float32(1e-6))
        return loss / max(n, 1.0)


def sequence_scores(p: dict[str, np.ndarray], ids: np.ndarray, sizes: np.ndarray, classes: Classes) -> np.ndarray:
    """log10 probability of each text of ``ids``, the next ``sizes`` ids each. Batches go on within a text: they take the block before along."""
    ends = np.cumsum(sizes)
    b = blocks_of(np.insert(ids, np.repeat(ends - sizes, 3), END), sizes + 3, np.zeros(len(sizes), np.int64), classes)
    each = np.zeros(len(b.owner))
    for a in range(0, len(each), CHUNK):
        before = 0 if b.fresh[a] else 1
        part = b.part(a - before, a + CHUNK)
        mask = part.mask
        if before:
            mask = mask.copy()
            mask[0] = False
        part = Blocks(part.rows, part.target, mask, part.fresh, part.owner)
        found = log10_probabilities(p, part, classes.of[part.target]) + classes.share[part.target] * mask
        each[a : a + CHUNK] = found[before:].sum(1)
    return np.bincount(b.owner, each, len(sizes))


def _train(path: str, classes: Classes, flat: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        trainer, held, skips, windows = Trainer(flat, classes, rate), [], [], 0

        def step() -> None:
            trainer.learn(blocks_of(np.concatenate(held), np.array(list(map(len, held))), np.array(skips), classes))
            held.clear()
            skips.clear()

        for batch in batches:
            for ids, skip in zip(batch.column("ids").to_pylist(), batch.column("skip").to_pylist(), strict=True):
                held.append(np.frombuffer(ids, np.uint16))
                skips.append(skip)
                windows += -(-(len(held[-1]) - 3) // SPAN)
                if windows >= STEP:
                    step()
                    windows = 0
        if held:
            step()
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.seen]), pa.array([trainer.p], pa.list_(pa.float32()))], names=["seen", "p"])

    return run


def deal(pieces: DataFrame, rounds: int) -> list[DataFrame]:
    """``(skip, ids)`` of each round's pieces, a task's partition being one hand. Every piece is in one round and one hand, by a
    hash of its place, and hands are read in the order of that hash."""
    total = pieces.agg(F.sum("size")).first()[0] or 0
    hands = max(1, -(-int(total) // (HAND * rounds)))
    dealt = pieces.select("skip", "ids", F.xxhash64("id", "piece", "row").alias("h")).withColumn("turn", F.pmod("h", F.lit(rounds))).withColumn("hand", F.pmod(F.shiftright("h", 20), F.lit(hands)).cast("int"))
    return [dealt.where(F.col("turn") == turn).repartitionById(hands, "hand").sortWithinPartitions("h").select("skip", "ids") for turn in range(rounds)]


def train(pieces: DataFrame, path: str, classes: Classes, rounds: int = 2, rate: float = 0.02) -> np.ndarray:
    """Parameters after ``rounds`` of local training on the hands of :func:`deal` and averaging by ids."""
    flat = first_parameters(classes)
    for turn, hands in enumerate(deal(pieces, rounds)):
        found = materialize(hands.mapInArrow(_train(path, classes, flat, rate / (turn + 1)), "seen double, p array<float>"), "parameters")
        each = found.select("seen", F.posexplode("p").alias("at", "x")).groupBy("at").agg((F.sum(F.col("seen") * F.col("x")) / F.sum("seen")).alias("x")).orderBy("at").toPandas()
        if len(each):
            flat = each["x"].to_numpy("float32")
    return flat


def _score(path: str, classes: Classes, flat: np.ndarray, frequent: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        lexicon, p, base = Lexicon(path), unpack(flat), np.zeros(0)
        logs = dict(zip(map(str.encode, frequent), np.log10(np.array(list(frequent.values()), np.float64) + 1).tolist(), strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            if len(lexicon.words) > _MEMO:
                lexicon.clear()
                base = np.zeros(0)
            words, place, n = texts_of(batch.column("text"))
            at, known = lexicon.numbers(words)
            at = at[place]
            base = np.concatenate([base, np.array([logs.get(w, np.nan) for w in lexicon.words[known:]], np.float64)])
            ids, upto = lexicon.spelled(at)
            score = sequence_scores(p, ids, np.diff(upto[np.cumsum(n) - 1], prepend=0), classes)
            first, part = np.cumsum(n) - n, base[at]
            rare = np.isnan(part)
            n_rare = np.add.reduceat(rare.astype(np.int64), first)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(place[rare])))
            arrays = [batch.column("row"), batch.column("id"), batch.column("held_out"), pa.array(n), pa.array(n - n_rare), pa.array(np.add.reduceat(np.where(rare, 0, part), first)), rest, pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "held_out", "n", "known", "part", "rest", "score"])

    return run


def language_scores(docs: DataFrame, held_out, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    held_out: a Column; rows where it is not true teach both models. Texts are whole, A-Z count as lower case; tokens
    are words and one end. base_score: sum over tokens of log10((c + 1) / (N + V + 1)) with c, N, V from training tokens. score:
    the attention model's log10 probability of the text's subword ids and its end. Null and empty texts are one token. Repeated
    rows are scored each and all teach; null identifiers stay null. Other columns are ignored; an empty table gives no
    rows. Without any training document N and V are 0 and the model is the one training starts from. What the driver and the
    tasks hold of the corpus is bounded: counts of ``FREQUENT`` words and of the vocabulary's ids.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    found = materialize(rows.where("NOT held_out").select("id", "row", "text").mapInArrow(_read_texts(path), "word string, c long, id long, row long, piece long, skip int, size long, ids binary"), "read")
    words = materialize(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("c").alias("c")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The commonest words: a threshold on the count that leaves at most FREQUENT of them.
    steps = words.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).toPandas()
    within = steps[steps["n"].cumsum() <= FREQUENT]
    least = int(within["c"].min()) if len(within) else None
    table = words.where(F.col("c") >= least).toPandas() if least else None
    frequent = dict(zip(table["word"].tolist(), table["c"].tolist(), strict=True)) if least else {}

    counts, company = id_counts(words, path)
    classes = make_classes(counts, company, np.lexsort((np.arange(IDS), -counts)), word_openers(path))
    short_batches(spark)
    flat = train(found.where("ids IS NOT NULL"), path, classes)
    scored = materialize(rows.mapInArrow(_score(path, classes, flat, frequent), "row long, id long, held_out boolean, n long, known long, part double, rest array<string>, score double"), "scored")
    rare = scored.select("row", F.explode("rest").alias("word")).join(words if not least else words.where(F.col("c") < least), "word")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1)).alias("rare_part"))
    out = scored.drop("rest").join(rare, "row", "left")
    base = F.col("part") + F.coalesce("rare_part", F.lit(0.0)) - F.col("n") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return language_scores(docs, held_out, vocabulary())
