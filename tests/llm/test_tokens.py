"""Token encoders, files and counts against the tokenizers libraries."""

import base64
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from loomstone.llm import bitplanes as B
from loomstone.llm import bpe
from loomstone.llm import token_counts as C

PATH = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "",
    None,
    " \n ",
    "Hello, World!! It's 1999.",
    "a\x1cb\x85c d　e",
    "ΣΑΣ ΌΔΟΣ Σ",
    "İstanbul H̱x Å Ḱ,́",
    "aaaaaaaaaaaaaaa",
    "don't 'Sfoo I'LL",
    "<|startoftext|>hi<|ENDOFTEXT|><|endoftext|>",
    "👩‍👩‍👧 1234 ½ Ⅷ ﬁ ǅ ẞ 日本語",
    "x" * 4000 + " " + "ab" * 2000,
    "word. " * 2000,
    "\x00\x01<| a<|b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_merge_rounds_agree_with_the_library(library):
    coder = bpe.WordBpe(PATH)
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS if "<|" not in (t or "")]):
        flat, sizes = coder.encode(pa.array(texts, pa.string()))
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [p.tolist() for p in parts] == want
        assert coder.decode(flat, sizes) == [library.decode(w, skip_special_tokens=False) for w in want]


@pytest.mark.parametrize("form", ["{0}", "x{0}y", "A{0}\u0301 {0}1", "1{0}\u0345\u0323"])
def test_every_code_point_is_encoded_as_by_the_library(library, form):
    coder, points = bpe.WordBpe(PATH), [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and not 0x32000 <= p < 0xE0000 and p < 0xE1000]
    for i in range(0, len(points), 50_000):
        texts = [form.format(chr(p)) for p in points[i : i + 50_000]]
        flat, sizes = coder.encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert np.array_equal(sizes, [len(w) for w in want]) and np.array_equal(flat, np.concatenate(want))


def test_random_strings_of_odd_characters(library):
    rng = random.Random(6)
    pools = [range(0x20, 0x7F), range(0x80, 0x600), range(0x900, 0x1100), range(0x1A00, 0x2100), range(0xA800, 0xABF0), range(0x10E00, 0x11400), range(0x1E000, 0x1FA00)]
    texts = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 40))) for _ in range(20_000)]
    flat, sizes = bpe.WordBpe(PATH).encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert np.array_equal(sizes, [len(w) for w in want]) and np.array_equal(flat, np.concatenate(want))


def test_encoder_forgets_and_goes_on(library, monkeypatch):
    import loomstone.llm.chunks as K

    monkeypatch.setattr(K, "MOST_RUNS", 3)
    coder = bpe.WordBpe(PATH)
    for text in ("one two three four five", "five six two", "one"):
        assert coder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_frames(spark, library):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int, text_ int")
    out = bpe.encode(docs, PATH, decoded="decoded")
    assert out.columns == ["doc_id", "text", "text_", "ids", "decoded"]
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].decoded == library.decode(ids, skip_special_tokens=False)
    again = {r.doc_id: r.back for r in bpe.decode(out, PATH, decoded="back").collect()}
    assert again == {i: r.decoded for i, r in rows.items()}
    odd = spark.createDataFrame([(None,), ([],), ([None, 320],), ([10**6, 320],)], "ids array<int>")
    one = library.decode([320], skip_special_tokens=False)
    assert [r.decoded for r in bpe.decode(odd, PATH).collect()] == [None, "", one, one]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("by", ["bit", "byte"])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [49407], [2**32 - 1, 0, 5], list(range(70_000))])
def test_planes_round_trip(by, ids):
    ids = np.array(ids, np.uint32)
    planes = B.to_planes(ids, by)
    assert (B.from_planes(planes, len(ids), by) == ids).all()
    if len(ids) and by == "bit":
        assert len(planes) == int(ids.max()).bit_length()


@pytest.mark.parametrize("by,block", [("byte", 64), ("bit", 64), ("bit", 1 << 16)])
def test_files_read_back(spark, library, tmp_path, monkeypatch, by, block):
    monkeypatch.setattr(B, "BLOCK_IDS", block)
    ids = [30, 4, 77, 8, 15, 16, 23, 42, 1, 2, 3, 99, 98, 97]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, shard string")
    path = str(tmp_path / "ids")
    B.write_ids(docs, path, PATH, by=by, shards=3)
    got = {r.doc_id: r for r in B.read_documents(spark, path, by).collect()}
    stream, start = [], 0
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids) == (start, len(want), want)
        stream, start = stream + want, start + len(want)
    digests = {r.doc_id: r.digest for r in B.read_documents(spark, path, by, B.crc32).collect()}
    assert digests[99] == zlib.crc32(np.array(got[99].ids, "<u4").tobytes())
    index = spark.read.parquet(f"{path}/index")
    assert index.agg(F.sum("n_ids")).first()[0] == start and index.count() == spark.read.parquet(f"{path}/blocks").count()
    for a, n in ((0, 5), (60, 10), (start - 7, 7)):
        assert B.read_slice(spark, path, a, n, by).tolist() == stream[a : a + n]


def test_files_of_nulls_ties_and_nothing(spark, tmp_path):
    rows = [(None, "a"), (5, "b"), (5, "c"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    B.write_ids(docs, str(tmp_path / "a"), PATH, shards=2)
    got = [(r.doc_id, r.start) for r in B.read_documents(spark, str(tmp_path / "a")).orderBy("start").collect()]
    B.write_ids(docs.repartition(3), str(tmp_path / "c"), PATH, shards=2)
    each = [sorted(map(str, B.read_documents(spark, str(tmp_path / k)).collect())) for k in "ac"]
    assert each[0] == each[1]
    assert [g[0] for g in got] == [None, 5, 5, 5] and got[0][1] == 0
    B.write_ids(docs.limit(0), str(tmp_path / "b"), PATH, shards=2)
    assert B.read_documents(spark, str(tmp_path / "b")).count() == 0


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def plain_sections(encoding, text, bounds, rule):
    """Tokens per section, a token at a time; bounds are byte positions of sections and the end."""
    counts, at = [0] * (len(bounds) - 1), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        owners = [max(k for k in range(len(counts)) if bounds[k] <= p) for p in range(at, at + size)]
        pick = {"first": owners[0], "last": owners[-1], "largest": max(sorted(set(owners)), key=owners.count)}[rule]
        counts[pick] += 1
        at += size
    return counts


@pytest.mark.parametrize("rule", C.RULES)
def test_counts_per_line(spark, ranks, rule):
    texts = ["", None, "\n", "a\n\n\nb", "one line", "é日本\n\n 👩‍👩‍👧 x\n", "x  \n\n\n  y\n", "w " * 5000, "\n\n\n"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    rows = C.count_tokens(docs, RANKS, public_tokenizers.PATTERN, rule).collect()
    for i, t in enumerate(texts):
        t = t or ""
        mine = sorted((r.section, r.char_start, r.char_end, r.n_tokens) for r in rows if r.doc_id == i)
        pieces = t.split("\n")
        lines = [p + "\n" for p in pieces[:-1]] + pieces[-1:]
        bounds = np.cumsum([0, *[len(x.encode()) for x in lines]]).tolist()
        chars = np.cumsum([0, *map(len, lines)]).tolist()
        assert [m[0] for m in mine] == list(range(len(lines)))
        assert [m[1:3] for m in mine] == list(zip(chars[:-1], chars[1:], strict=True))
        assert [m[3] for m in mine] == plain_sections(ranks, t, bounds, rule)
        assert sum(m[3] for m in mine) == len(ranks.encode_ordinary(t))


def test_counts_per_field(spark, ranks):
    docs = spark.createDataFrame([(1, "Title one", None, "body\ntext"), (2, "", "x", "y")], "doc_id long, a string, b string, c string")
    got = C.count_tokens(docs, RANKS, public_tokenizers.PATTERN, "first", ["a", "b", "c"])
    for i, whole in ((1, "Title one\n\nbody\ntext"), (2, "\nx\ny")):
        rows = [r for r in got.collect() if r.doc_id == i]
        assert len(rows) == 3 and sum(r.n_tokens for r in rows) == len(ranks.encode_ordinary(whole))
    assert C.count_tokens(docs.limit(0), RANKS, public_tokenizers.PATTERN, text="a").count() == 0
    with pytest.raises(ValueError):
        C.count_tokens(docs, RANKS, public_tokenizers.PATTERN, "half", text="a")
