"""Pieces, token alignment and hash trees against the libraries and plain versions: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkreco.llm import alignment as A
from sparkreco.llm import merkle, pieces, queries, words

MODEL, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def _texts():
    rng = random.Random(11)
    some = ["".join(rng.choice(["the ", "naïve", " a", "  ", "\n", "\t", "字", "'re ", "12", " ", "　", "é", "<s>", "▁", "x" * 9, "-", "🙂"]) for _ in range(60)) for _ in range(40)]
    some += ["", " ", "   ", "▁", "▁▁ a", "a ", " a", "a▁ b", "a ▁b", "\0 \0a", "<|endoftext|> </s> <0x41>", "a\n  b", "a \n b", "x" * 70000, "word " * 20000, "日本語 テキスト", "ﬁ ﬀ É", None]
    return [*enumerate(some), (3, some[3]), (3, some[4]), (None, "no id"), (None, some[0])]


@pytest.fixture
def table(spark):
    rows = [(i, t, "en", "key", i, 7) for i, t in _texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, groups string, block string, id long, ids int").repartition(4)


@pytest.fixture(params=[2000, 1 << 22])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", request.param)
    monkeypatch.setattr(A, "BLOCK_BYTES", request.param)


def test_pieces_equal_the_library(table, block_bytes, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED", 500)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in pieces.encode_and_decode(table, MODEL).collect())
    coded = [(i, LIBRARY.encode(t or "", add_bos=True, add_eos=True)) for i, t in _texts()]
    assert got == Counter((i, tuple(x), LIBRARY.decode(x)) for i, x in coded)
    packed = pieces.encode_and_decode(table, MODEL, packed=True).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in packed) == Counter((i, np.array(x, "<u4").tobytes()) for i, x in coded)


def test_words_that_many_blocks_share(spark, monkeypatch):
    df = spark.createDataFrame([(i, "the same words in every text, and one more: w%d" % i) for i in range(30)], "doc_id long, text string").repartition(6)
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 100)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode_and_decode(df, MODEL).collect()}
    assert got == {i: LIBRARY.encode("the same words in every text, and one more: w%d" % i, add_bos=True, add_eos=True) for i in range(30)}
    assert words.marked_words("the the  of") == [" the", " the", "  of"]


def test_models_that_cross_markers_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    pieces.check_model(model.SerializeToString())
    model.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(model.SerializeToString())


def test_cuts_of_words_are_alike_for_both_tokenizers():
    for _, t in _texts():
        if t and words.MARK not in t:
            own = words.plain_words(t)
            assert "".join(own) == " " + t
            whole = TOKENIZER.encode(" " + t, add_special_tokens=False).ids
            assert [i for w in own for i in TOKENIZER.encode(w, add_special_tokens=False).ids] == whole


def test_union_find():
    rng = random.Random(5)
    for n in (1, 2, 50, 300):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2 // 3)] + [(i, i + 1) for i in range(0, n // 2)]
        label = list(range(n))
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        assert A.components(n, np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int)).tolist() == label


_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _VISIBLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def _groups(text):
    """Plain: cut where ends of both meet."""
    if not text:
        return None
    a, b, want = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, LIBRARY.encode(text), (" " + text).encode()
    sides = [(a, [bytes(_BYTE_OF[c] for c in TOKENIZER.id_to_token(i)) for i in a]), (b, [bytes([int(LIBRARY.id_to_piece(i)[3:5], 16)]) if LIBRARY.is_byte(i) else LIBRARY.id_to_piece(i).replace("▁", " ").encode() for i in b])]
    if any(b"".join(parts) != want for _, parts in sides):
        return None
    ends = [np.cumsum([len(x) for x in parts]) for _, parts in sides]
    both = np.intersect1d(*ends)
    out = [([], []) for _ in both]
    for side, (ids, _) in enumerate(sides):
        for i, g in zip(ids, np.searchsorted(both, ends[side]).tolist(), strict=True):
            out[g][side].append(i)
    return out


@pytest.mark.parametrize("large", [0, 1 << 12])
def test_alignment_against_a_plain_version(table, block_bytes, monkeypatch, large):
    monkeypatch.setattr(A, "LARGE_GROUP", large)
    found = A.align(table, RANKS, public_tokenizers.PATTERN, MODEL)
    groups = [(i, _groups(t)) for i, t in _texts()]
    held, best = Counter(), Counter()
    for _, g in groups:
        held.update({(x, y) for a, b in g or () for x in a for y in b})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = Counter()
    for i, g in groups:
        links = Counter((x, y) for a, b in g or () for x in a for y in b)
        sums = (sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), links.total(), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()))
        want[i, *sums, ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or ())] += 1
    assert Counter(map(tuple, found.documents.collect())) == want
    assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in found.pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in held.items()}


def test_tokens_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode_and_decode(empty, MODEL).collect() == []
    found = A.align(empty, RANKS, public_tokenizers.PATTERN, MODEL)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(leaves, fanout):
    steps, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for k, p in enumerate(at):
            run = now[p // fanout * fanout : p // fanout * fanout + fanout]
            steps[k].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
            at[k] = p // fanout
        now = [_h("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)]
    return now[0], steps


def _plain_manifest(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        made[s] = (own, *_tree([_leaf(r) for r in own], fanout))
    root, over = _tree([made[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, over, strict=True):
        own, subroot, steps = made[s]
        out += [(r, _leaf(r), subroot, root, [*x, *top]) for r, x in zip(own, steps, strict=True)]
    return out


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_against_a_plain_version(spark, fanout):
    rng = random.Random(fanout)
    sources = ["a", "b", "", None, "ü", "Z", *[f"s{i}" for i in range(20)]]
    rows = [(i, "hot" if i % 3 else rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 3, 123]), rng.choice(["Text", "", None, "Ünï"])) for i in range(150)]
    rows += [(5, "hot", "en", 1, "again"), (5, "hot", "en", 1, "again"), (None, "hot", "en", 1, "X"), (None, None, None, None, None), (900, "alone", "en", 4, "T")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "group": F.lit("x"), "run": F.lit(2), "n": F.lit(0)}).repartition(7)
    found = merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], fanout=fanout)
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in found.collect())
    want = _plain_manifest(rows, fanout)
    assert got == Counter((r[0], leaf, subroot, root, tuple(steps)) for r, leaf, subroot, root, steps in want)
    checked = found.select(merkle.folded(F.col("leaf"), F.col("proof")).alias("f"), "root").filter("f <> root").count()
    assert checked == 0


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(spark.createDataFrame([], schema), fields).collect() == []
    row = (1, None, None, None, None)
    one = merkle.manifest(spark.createDataFrame([row], schema), fields).first()
    assert one["leaf"] == one["subroot"] == one["root"] == _leaf(row) and one["proof"] == []


def test_digests_of_the_queries(spark, tmp_path):
    rows = [(i, "src" if i % 4 else None, "en", i, f"Doc {i} Of Text  more") for i in range(40)] + [(40, "s", "en", 0, None), (41, "s", "en", 0, ""), (42, "s", "en", 0, "a▁b")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op11_pieces(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(rows[r["doc_id"]][4] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), _h(LIBRARY.decode(ids)))
    for r in queries.op12_alignment(spark, str(tmp_path)).collect():
        g = _groups(rows[r["doc_id"]][4])
        assert r["groups_sha256"] == (_h(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)) if g else "") and r["n_groups"] == len(g or ())
    plain = {r[0]: (leaf, subroot, root, steps, r) for r, leaf, subroot, root, steps in _plain_manifest(rows, 16)}
    for r in queries.op13_merkle(spark, str(tmp_path)).collect():
        leaf, subroot, root, steps, row = plain[r["doc_id"]]
        node = leaf
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and row[4] is not None:
            node = _leaf((*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)})))
        for a, b in steps:
            node = _h(a + node + b)
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) == (leaf, subroot, root, _h("".join(a + b for a, b in steps)), node, node == root)
