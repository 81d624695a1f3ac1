"""Each operator on small tables against brute force: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkreco.llm import blocks as B
from sparkreco.llm.bpe import encode_and_decode
from sparkreco.llm.html_text import extract_main_text, main_text
from sparkreco.llm.jaccard import drop_near_copies, jaccard_components
from sparkreco.llm.repeats import remove_repeats
from sparkreco.llm.suffix import SuffixSorter, difference_cover
from sparkreco.llm.suffix_dedup import cut_repeats, remove_repeated_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _words(rng, n):
    return " ".join(rng.choice(["the", "of", "Thé", "naïve", "a", "über", "wörd", "token", "x1", "lorem", "ipsum"]) + rng.choice(["", "s", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    line, passage = _words(rng, 12), _words(rng, 60)
    out = [(i, _words(rng, rng.randrange(1, 120))) for i in range(40)]
    out += [(100 + i, _words(rng, 20) + "\n" + line + "\n" + _words(rng, 20)) for i in range(6)]
    out += [(200 + i, _words(rng, 5) + " " + passage + "  " + _words(rng, 5)) for i in range(4)]
    out += [(300, out[0][1]), (301, out[0][1]), (302, out[0][1].upper()), (303, out[3][1] + " end"), (0, out[5][1])]
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one two"), (404, "ONE two"), (None, out[1][1]), (405, passage * 3), (406, "ab " * 3000)]
    return out


@pytest.fixture
def docs(spark, texts):
    rows = [(i, t, "en", "key", i, 7, "label") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, block string, id long, payload int, label string").repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 2000)


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (100, 30), (40, 4)])
def test_bpe_matches_the_library_and_round_trips(docs, texts, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = encode_and_decode(docs, RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap=overlap).collect()
    want = Counter((i, tuple(whole.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == want


def test_bpe_of_hard_chunks(spark):
    rng = random.Random(1)
    hard = ["".join(rng.choice("a b\n\t'rest  1é字") for _ in range(400)) for _ in range(30)] + ["x" * 500, " " * 500, "'re" * 200]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    a = {r["doc_id"]: r["ids"] for r in encode_and_decode(df, RANKS, public_tokenizers.PATTERN, chunk_chars=50, overlap=12).collect()}
    b = {r["doc_id"]: r["ids"] for r in encode_and_decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert a == b


def test_difference_cover_meets_all_residues():
    for v in (4, 8, 16, 32):
        d = difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_blockwise_suffix_array():
    rng = random.Random(2)
    for n, alphabet, v in [(0, 2, 8), (1, 1, 8), (5, 1, 32), (300, 1, 16), (400, 2, 8), (500, 256, 32), (700, 3, 32)]:
        t = bytes(rng.randrange(alphabet) for _ in range(n))
        for text in (t, (t[:20] * 40)[:n]):
            got = SuffixSorter(np.frombuffer(text, np.uint8), v).array(rng.choice([10, 100, 1 << 20]))
            assert got.tolist() == sorted(range(n), key=lambda i: text[i:])


def _brute_bytes(texts, length):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in texts:
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, rank(i)), rank(i))
    out = []
    for i, t in texts:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < rank(i):
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return Counter(out)


@pytest.mark.parametrize("length", [50, 20])
def test_suffix_dedup_against_brute_force(docs, texts, length):
    got = remove_repeated_bytes(docs, length).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == _brute_bytes(texts, length)


def test_cut_repeats_keeps_columns_and_whole_characters(docs, texts):
    got = cut_repeats(docs, 50)
    assert got.columns == docs.columns
    want = Counter()
    for (i, size, removed, _, kept), n in _brute_bytes(texts, 50).items():
        text = kept.decode("utf-8", "ignore")
        if text or not size:
            want[i, text] += n
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == want


def _brute_repeats(texts, window):
    words = [(i, (t or "").encode().split()) for i, t in texts]
    seen = Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    return want


@pytest.mark.parametrize("window", [35, 8])
def test_repeats_against_brute_force(docs, texts, window):
    got = remove_repeats(docs, window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == _brute_repeats(texts, window)


def _sets(texts):
    out = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])))
    return out


def _classes(texts):
    sets = _sets(texts)
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sets, root


@pytest.mark.parametrize("part", [1024, 3])
def test_jaccard_components_against_brute_force(docs, texts, part, monkeypatch):
    from sparkreco.llm import jaccard

    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(9)
    base = _words(rng, 80).split()
    more = [(1000 + k, " ".join(base[: 70 + k % 10] + [f"z{k}"] * (k % 4))) for k in range(25)]
    every = texts + more
    df = docs.unionByName(docs.sparkSession.createDataFrame([(i, t, "en", "key", i, 7, "label") for i, t in more], docs.schema))
    sets, root = _classes(every)
    least = {}
    for (i, _), r in zip(sets, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, len(s), least.get(r)) for (i, s), r in zip(sets, root, strict=True))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()) == want
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    stays = Counter()
    for r in set(root):
        members = [i for (i, s), q in zip(sets, root, strict=True) if q == r]
        stays[min(members, key=lambda i: (i is None, i or 0))] += 1
    assert Counter(r["doc_id"] for r in kept.collect()) == stays


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_and_decode(df, RANKS, public_tokenizers.PATTERN).count() == 0
    assert remove_repeated_bytes(df).count() == 0
    assert cut_repeats(df).count() == 0
    assert remove_repeats(df).count() == 0
    assert jaccard_components(df).count() == 0
    assert drop_near_copies(df).count() == 0


PAGE = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a href=1>Home</a></nav>{}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<div></div>", ""),
        (PAGE.format("<div class='ad'>Buy now, it is cheap</div><article><h1>A  title</h1><p>One, two &amp; three.<p><b>Four</b>five<br>six</article>"), "A title One, two & three. Fourfive six"),
        (PAGE.format("<div id=content><p>First long part, with commas, and words.</p><p>Second part.</p></div><div class=sidebar><p>Other, other, other, other</p></div>"), "First long part, with commas, and words. Second part."),
        (PAGE.format("<main><p>Text, and more text.</p><section class='comments'><p>I agree, I agree, I agree</p></section></main>"), "Text, and more text."),
        (PAGE.format("<form><p>Name, address, and so on</p></form><article><p>Body &lt;b&gt; here, yes</article>"), "Body <b> here, yes"),
        ("<article><p>never closed, still read <!-- and this not", "never closed, still read"),
        ("<article><p title=it's>one, two</p><p>three, four</p></article>", "one, two three, four"),
        ("<article><a href=x title=Bob's>Link</a><p data-id='share' title = 'a > b'>one, two</p><p title=\"id=ad\">three, four</p></article>", "Link one, two three, four"),
        ("<article><p>one, two</p><div class='sponsored-content'><p>Buy, buy</p></div><div id=newsletter-content>Sign up</div><div class='cookie-content post'>We bake</div><p>three</p></article>", "one, two three"),
        ("<body class=content><div class='content-sidebar-wrap'><div class='main no-sidebar'><p>one, two</p></div><div class=sidebar-content>more, more</div></div>", "one, two"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("sentences", [1, 30, 300])
@pytest.mark.parametrize("outer", ["article", "main", "div"])
def test_main_text_keeps_what_stands_beside_the_body(outer, sentences):
    body = " ".join(["One sentence, with a comma, and some more words in it."] * sentences)
    inner = f"<h1>T</h1><p>Lead.</p><div class=text><p>{body}</p><p>{body}</p></div><div class=share>Send it</div><section><h2>End</h2><p>Last words.</p></section>"
    page = PAGE.format(f"<div><{outer}>{inner}</{outer}></div><div class=sidebar><p>Other, other, other</p></div>")
    assert main_text(page) == f"T Lead. {body} {body} End Last words."


@pytest.mark.parametrize("paragraphs", [1, 2, 4, 40])
def test_main_text_keeps_titles_and_closing_words_of_any_size(paragraphs):
    body = "<p>One sentence, with a comma, and some more words in it.</p>" * paragraphs
    text = " ".join(["One sentence, with a comma, and some more words in it."] * paragraphs)
    page = f"<body><nav><a href=1>Home</a></nav><h1>The title</h1><p>Lead.</p><div class=text>{body}</div></body>"
    assert main_text(page) == f"The title Lead. {text}"
    page = f"<body><div id=page><div class=head2><h1>The title</h1><a href=4>by A</a></div><div class=text>{body}</div><p>Closing words.</p></div></body>"
    assert main_text(page) == f"The title by A {text} Closing words."
    links = "<ul><li><a href=2>One</a><li><a href=3>Two</a></ul>"
    assert main_text(page.replace("</p></div></body>", f"</p>{links}</div></body>")) in (f"The title by A {text} Closing words.", f"The title by A {text} Closing words. One Two")


def test_main_text_of_deep_and_broken_pages():
    deep = "<div>" * 20000 + "<p>one, two</p></span></b>" + "<p>three</p></x>" * 2000
    assert main_text(deep) == "one, two" + " three" * 2000
    assert main_text("<article><p>one, two <a title='never closed>three</p></article>") == "one, two"


def test_main_text_of_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")
    assert extract_main_text(df).count() == 0
    clash = spark.createDataFrame([(1, "u", PAGE.format("<article><p>x, y</article>"), "mine", 7)], df.schema)
    assert [tuple(r) for r in extract_main_text(clash).collect()] == [(1, "u", "x, y")]


def test_main_text_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE.format("<article><p>x, y</article>"), 3), (None, None, None, 4), (1, "u", "plain words", 5)], "page_id long, url string, html string, text2 int")
    got = sorted((r["page_id"] or 0, r["text"]) for r in extract_main_text(df).collect())
    assert got == [(0, ""), (1, "plain words"), (1, "x, y")]


def test_digests_of_queries(spark, tmp_path):
    from sparkreco.llm.queries import QUERIES

    spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_bpe"](spark, str(tmp_path)).collect()}
    assert got[2]["n_tokens"] == 0 and got[2]["ids_sha256"] == got[2]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[1]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert QUERIES["op6_suffix_dedup"](spark, str(tmp_path)).filter(F.col("n_removed") > 0).count() == 0


def _thue_morse(bits, a, b):
    out = [a]
    for _ in range(bits):
        out += [b if x == a else a for x in out]
    return out


def test_patterned_texts_do_not_collide(spark):
    """Texts on which a polynomial modulo a power of two is blind."""
    from sparkreco.llm.bilinear import score_texts

    x, y = "".join(_thue_morse(11, "a", "b")), "".join(_thue_morse(11, "b", "a"))
    pair = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_components(pair).collect()} == {1, 2}
    scored = {r["doc_id"]: r["n_known"] for r in score_texts(pair, F.col("doc_id") == 1).collect()}
    assert scored == {1: 2, 2: 1}
    rest = " ".join(f"w{k}" for k in range(34))
    words = spark.createDataFrame([(1, f"{rest} {x[:1024]}"), (2, f"{rest} {y[:1024]}"), (3, " ".join(_thue_morse(10, "u", "v"))), (4, " ".join(_thue_morse(10, "v", "u")))], "doc_id long, text string")
    plain = [(r["doc_id"], r["text"]) for r in words.collect()]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(words, 35).collect()) == _brute_repeats(plain, 35)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeated_bytes(pair, 50).collect()) == _brute_bytes([(1, x), (2, y)], 50)


def _rounds(blocks, window):
    """The exchanges of three blocks and one bucket, by hand: what each brings, and the passages that it gets."""
    from sparkreco.llm import repeats as R

    got = [{} for _ in blocks]
    asks = [lambda w, g: B.send_by_bucket(np.unique(R._Anchors(w, window).keys), 1, 8), lambda w, g: B.send_by_bucket(np.unique(w.grams(window)[0][R._around(w, g, 1, window)[0]]), 1, 8), lambda w, g: R._Pieces(w, g, 1, window).claims()]
    for k, (ask, answer) in enumerate(zip(asks, [lambda r: B.answer_shared(r, 8), lambda r: B.answer_shared(r, 8), R._choose], strict=True)):
        for g, said in zip(got, answer([ask(w, g)[0] for w, g in zip(blocks, got, strict=True)]), strict=True):
            g[k] = said
    brought = [R._texts(w.data, R._Pieces(w, g, 1, window).note(), {0: g[2]})[0] for w, g in zip(blocks, got, strict=True)]
    return brought, R._confirm(brought, window)


@pytest.mark.parametrize("letters", [0x100, 0xD7FA])  # the second: alphabets around the surrogates
def test_the_automaton_finds_what_a_block_never_brought(monkeypatch, letters):
    from sparkreco.llm import repeats as R

    monkeypatch.setattr(R, "LETTERS", letters)
    passage = " ".join(f"p{k}" for k in range(12))
    texts = [f"{' '.join(f'{c}{k}' for k in range(20))} {passage} {' '.join(f'{c}{k}' for k in range(20, 40))}" for c in "abc"]
    blocks = [B.Block(np.array([i]), np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.uint8)).words() for i, t in enumerate(texts)]
    brought, passages = _rounds(blocks, 8)
    assert [b"p5" in B.unsqueeze(r) for r in brought] == [True, True, False]  # the third block's text goes nowhere
    for w, p in zip(blocks, passages, strict=True):
        assert np.flatnonzero(R._located(w, {0: p}, 8)).tolist() == list(range(20, 32))
    # a passage of the shard that this block's own windows say nothing of is found too
    more = B.squeeze(B.unsqueeze(passages[2]) + b"\n" + " ".join(f"c{k}" for k in range(3, 11)).encode())
    assert np.flatnonzero(R._located(blocks[2], {0: more}, 8)).tolist() == [*range(3, 11), *range(20, 32)]
    monkeypatch.setattr(R, "automaton", lambda passages: type("Nothing", (), {"iter": staticmethod(lambda text: [])})())
    assert not R._located(blocks[2], {0: passages[2]}, 8).any()


def test_repeats_of_a_passage_in_many_blocks(spark, monkeypatch):
    rng = random.Random(21)
    passage = _words(rng, 50)
    rows = [(i, f"{_words(rng, 40)} {passage if i % 3 else ' '.join(passage.split()[5:44])} {_words(rng, 40)}") for i in range(30)]
    monkeypatch.setattr(B, "BLOCK_BYTES", 700)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 35).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == _brute_repeats(rows, 35)
