import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import cases
from voxloom.llm.packing import OpenBins, json_encoder, pack_documents, ranks_encoder, vocabulary


def test_round_trip(spark):
    found = cases.rows()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = pack_documents(cases.frame(spark), vocabulary()).collect()
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, text, *_ in found:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and (len(own) == 1 or len(ids) > 1024)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 1024) + 1


def test_encoders_agree():
    one, two = ranks_encoder(vocabulary()), json_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _, text, *_ in cases.rows():
        assert one(text or "").tolist() == two(text or "").tolist()
    for text in ("a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n  <|endoftext", "<|ENDOFTEXT|>"):
        assert one(text).tolist() == two(text).tolist()
    assert one("a<|endoftext|>b").tolist() == [64, 50256, 65]


def brute_bins(lengths, size, bound):
    """Best fit over a plain list of open bins; the fullest one closes where one more would be open."""
    placed, opened, free = [], 0, []  # free: [space, bin]
    for n in lengths:
        fits = [x for x in free if x[0] >= n]
        if fits:
            x = min(fits)
            free.remove(x)
        else:
            x, opened = [size, opened], opened + 1
        placed.append((x[0], x[1]))
        if x[0] > n:
            free.append([x[0] - n, x[1]])
            if len(free) > bound:
                least = min(space for space, _ in free)
                free.remove(max((x for x in free if x[0] == least), key=free.index))
    return opened, placed


def test_open_bins_are_bounded():
    bins, held = OpenBins(10, 2), {}
    for n in (6, 5, 7, 3, 2, 10, 4, 1, 9):
        b, offset = bins.place(n)
        assert offset == held.get(b, 0)
        held[b] = offset + n
        assert held[b] <= 10 and bins.count <= 2
    assert bins.opened == len(held)


def test_the_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    for n in (4, 7, 9):  # free 6, 3 and 1: the third, the fullest, closes itself
        bins.place(n)
    assert [k for k in range(11) if bins.free >> k & 1] == [3, 6] and bins.count == 2
    assert bins.place(5) == (0, 4)  # free 1 and 3
    assert bins.place(6) == (3, 0)  # free 4: of 1, 3 and 4 that with 1 closes
    assert [k for k in range(11) if bins.free >> k & 1] == [3, 4] and bins.count == 2
    assert bins.place(1) == (1, 7)


def test_placement_against_brute_force():
    rng = np.random.default_rng(4)
    for bound in (1, 3, 8, 1000):
        lengths = rng.integers(1, 65, 600).tolist()
        bins = OpenBins(64, bound)
        spaces = [64 - bins.place(n)[1] for n in lengths]
        opened, placed = brute_bins(lengths, 64, bound)
        assert bins.opened == opened and spaces == [space for space, _ in placed]


def test_sequences_are_few():
    """A fixed number of open bins costs little: short pieces fill what long ones leave."""
    rng = np.random.default_rng(6)
    lengths = [int(min(1024, n)) for n in rng.lognormal(5.8, 1.0, 20_000)]
    bins = OpenBins(1024, 128)
    for n in lengths:
        bins.place(n)
    assert bins.opened <= 1.015 * sum(lengths) / 1024


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = pack_documents(df, vocabulary()).collect()
    assert len(got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3
    assert pack_documents(cases.empty(spark), vocabulary()).count() == 0
