import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken
from fleetbump.llm import alignment, byte_bpe, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  \n\n\t x", "x" * 3000, "é" * 700 + "漢字かな" * 50, "á 1² ①", "<|endoftext|> <s> </s>", "▁ x", "I'm we'll 'tis",
    "\U0001f600\U0001f469‍\U0001f4bb", "࢏꟎\U0001e6c0\U00012550", "tab\there \x00 null", "    wide", "ﬁ ½ Å",
]


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def vocabulary():
    ranks = byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.Vocabulary(ranks, public.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def files():
    return alignment.Tokenizers.read(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


def test_hash_is_minimal_and_perfect(vocabulary):
    for numbers in (vocabulary.hashes, vocabulary.hashes[:1], vocabulary.hashes[:0], vocabulary.hashes[:1001]):
        slots = byte_bpe.PerfectHash(numbers).slot(numbers)
        assert sorted(slots.tolist()) == list(range(len(numbers)))


def test_encoder_equals_library(vocabulary, library, texts, monkeypatch):
    every = [
        "".join(f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}  {chr(c)}{chr(c)}" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000)
        for at in (*range(0, 0x20000, 512), *range(0x2A000, 0x34000, 512), *range(0x3D000, 0x40000, 512), *range(0xE0000, 0xE1000, 512))
    ]
    encoder = byte_bpe.Encoder(vocabulary)
    for some in (texts + ODD, every):
        ids, first = encoder.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(t) for t in some]
    # Runs and the lazy cut of long texts change nothing; neither does a full table of kept pre-tokens.
    monkeypatch.setattr(byte_bpe, "LONG_CHARS", 50)
    monkeypatch.setattr(byte_bpe, "RUN", 7)
    monkeypatch.setattr(byte_bpe, "KEPT", 3)
    ids, first = byte_bpe.Encoder(vocabulary).encode(texts[:9] + ODD)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(t) for t in texts[:9] + ODD]


def test_round_trip(spark, vocabulary, library, documents):
    encoded = byte_bpe.encode(documents, vocabulary)
    want = sorted(((r.doc_id, library.encode_ordinary(r.text or "")) for r in documents.collect()), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    decoded = sorted(((r.doc_id, bytes(r.bytes)) for r in byte_bpe.decode(encoded, vocabulary).collect()), key=str)
    assert decoded == sorted(((r.doc_id, (r.text or "").encode()) for r in documents.collect()), key=str)


@pytest.mark.parametrize("run", [5, byte_bpe.RUN])
def test_digests(spark, vocabulary, library, documents, clashing, nothing, run, monkeypatch):
    rows = documents.collect()
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    assert Counter(map(tuple, byte_bpe.digests(documents, vocabulary).collect())) == want
    assert Counter(map(tuple, byte_bpe.digests(clashing, vocabulary).collect())) == want
    assert byte_bpe.digests(nothing, vocabulary).count() == 0


def test_op11_on_a_table(spark, library):
    found = {r.doc_id: r for r in queries.QUERIES["op11_byte_bpe"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert found[d.doc_id].n_tokens == len(ids)
        assert found[d.doc_id].ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert found[d.doc_id].decoded_sha256 == sha((d.text or "").encode())


def plain_alignment(texts):
    """Groups, links and counts by sets of offsets, text by text."""
    a_of = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    byte = alignment.byte_level()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a_of.get_vocab(with_added_tokens=False).items()}
    docs, held = [], Counter()
    for text in texts:
        text = text or ""
        a = a_of.encode(" " + text, add_special_tokens=False).ids
        b = b_of.encode(text)
        piece = [b_of.id_to_piece(i) for i in b]
        b_strings = [bytes([int(p[3:5], 16)]) if b_of.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(piece, b)]
        a_strings = [a_bytes[i] for i in a]
        whole = (" " + text).encode()
        if not text or b"".join(a_strings) != whole or b"".join(b_strings) != whole:
            docs.append(([], [], [], Counter()))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_strings]).tolist(), np.cumsum([len(x) for x in b_strings]).tolist()
        groups = defaultdict(lambda: ([], []))
        cuts = sorted(set(a_ends) & set(b_ends))
        for side, (ids, ends) in enumerate(((a, a_ends), (b, b_ends))):
            for i, end in zip(ids, ends):
                groups[bisect_left(cuts, end)][side].append(i)
        links = Counter((x, y) for g in groups.values() for x in g[0] for y in g[1])
        held.update(set(links))
        docs.append((a, b, [groups[g] for g in sorted(groups)], links))
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for a, b, groups, links in docs:
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            len(a), len(b), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if held[p] == highest[p[0]]), sum(n * held[p] for p, n in links.items()), listed,
        ))
    return out


@pytest.mark.parametrize("lane,wide,table", [(256, 1 << 16, 500_000), (4, 1, 20), (8, 3, 0)])
def test_alignment_equals_brute_force(spark, files, documents, lane, wide, table, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE", table)
    odd = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(odd).repartition(3, "doc_id")
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, plain_alignment([r.text for r in rows]), strict=True))
    found = alignment.scored(alignment.written(alignment.align(docs, files), "aligned"))
    assert Counter(map(tuple, found.collect())) == want
    # The same with other lanes and groups handed on as pairs, in this process.
    monkeypatch.setattr(alignment, "LANE", lane)
    monkeypatch.setattr(alignment, "WIDE", wide)
    e = alignment.Encoders(files)
    a, a_first, b, b_first = e.tokens([r.text or "" for r in rows])
    found = alignment.lockstep(a, e.a_runs.lengths[a], a_first, b, e.b_runs.lengths[b])
    listed = alignment._listed(e, found, a, b, a_first, b_first)
    links = np.bincount(found.doc, weights=found.links, minlength=len(rows)).astype(int)
    plain = plain_alignment([r.text for r in rows])
    assert [x.decode() for x in listed] == [p[6] for p in plain]
    assert links.tolist() == [p[3] for p in plain]


def test_lockstep_on_random_cuts():
    rng = random.Random(5)
    for _ in range(50):
        a_sizes, b_sizes, a_first, want = [], [], [0], []
        for doc in range(rng.randint(0, 5)):
            n = rng.randint(0, 60)
            inner = [sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) if n > 1 else [] for _ in "ab"]
            ends = [[*x, n] if n else [] for x in inner]
            base = [len(a_sizes), len(b_sizes)]
            a_sizes += np.diff([0, *ends[0]]).tolist()
            b_sizes += np.diff([0, *ends[1]]).tolist()
            cuts = sorted(set(ends[0]) & set(ends[1]))
            group = [[np.searchsorted(cuts, e) for e in x] for x in ends]
            want += [(doc, base[0] + i, base[1] + j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h]
            a_first.append(len(a_sizes))
        a_ids, b_ids = np.arange(len(a_sizes)), np.arange(len(b_sizes))
        found = alignment.lockstep(a_ids, np.array(a_sizes, int), np.array(a_first), b_ids, np.array(b_sizes, int))
        assert sorted(zip(found.doc, found.a, found.b)) == sorted(want)


def test_alignment_of_little(spark, files, nothing, clashing, documents):
    assert alignment.alignments(nothing, files).count() == 0
    blank = spark.createDataFrame([(1, None), (None, ""), (2, "▁")], "doc_id long, text string")
    assert Counter(map(tuple, alignment.alignments(blank, files).collect())) == Counter([(i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 2)])
    same = [Counter(map(tuple, alignment.alignments(d, files).collect())) for d in (documents, clashing)]
    assert same[0] == same[1]


def test_op13_on_a_table(spark):
    found = queries.QUERIES["op13_alignment"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter(
        (d.doc_id, *w[:6], sha(w[6].encode()) if w[6] else "") for d, w in zip(docs, plain_alignment([d.text for d in docs]), strict=True)
    )
    assert Counter(map(tuple, found.collect())) == want
    assert found.agg(F.sum("n_links")).first()[0] > 0


def test_short_and_long_pretokens_are_joined_alike(vocabulary, library):
    rng = np.random.default_rng(11)
    encoder = byte_bpe.Encoder(vocabulary)
    sizes = [*range(1, 20), byte_bpe.SHORT - 1, byte_bpe.SHORT, byte_bpe.SHORT + 1]
    pieces = [bytes(rng.choice(list(some), n)) for n in sizes for some in (b"aab", b"etaoin", bytes(range(256)), "éß好".encode())]
    for piece in pieces:
        assert encoder._joined_short(piece) == encoder._joined_long(piece)
    # The same again, and more different ones than one number could hold apart, are gathered each at its place.
    words = ["".join(rng.choice(list("xqjzé"), n)) for n in (5, 9, byte_bpe.SHORT, byte_bpe.SHORT + 9, 90) for _ in range(30)]
    ids, first = encoder.encode(words + words)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(w) for w in words + words]
