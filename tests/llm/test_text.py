"""Piece sampling, packing, licences, quality, pages, URLs and neighbours."""

import collections
import itertools
import math
import random
import textwrap
import time
import zlib
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from millrace.llm import html_paths as H  # noqa: E402
from millrace.llm import licenses as C  # noqa: E402
from millrace.llm import neighbours as N  # noqa: E402
from millrace.llm import packing as K  # noqa: E402
from millrace.llm import piece_sampling as P  # noqa: E402
from millrace.llm import quality_ngrams as Q  # noqa: E402
from millrace.llm import url_rules as U  # noqa: E402
from millrace.llm.queries import tokenizer_file  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

ODD = ["", None, "a", "  two  blanks ", "line\nbreak\ttab", "Straße é 漢字 😀 ▁mark", "word " * 3000, "x" * 3000]


def segmentations(model, text):
    known = {p: (int(i), lp) for n in model.tables for p, i, lp in ((model.pieces[i], i, lp) for i, lp in zip(*model.tables[n][1:], strict=True) if i >= 0)}

    def parts(t):
        if not t:
            yield (), 0.0
        for j in range(1, min(model.longest, len(t)) + 1):
            if t[:j] in known:
                i, lp = known[t[:j]]
                for rest, s in parts(t[j:]):
                    yield (i, *rest), lp + s

    whole = {}
    for combo in itertools.product(*[list(parts(c)) for c in P.chunks(text)]):
        whole[sum((c[0] for c in combo), ())] = sum(c[1] for c in combo)
    z = math.log(sum(map(math.exp, whole.values())))
    return {k: v - z for k, v in whole.items()}


def test_samples_follow_the_lattice():
    model = P.piece_model(tokenizer_file("piece_bpe_32k.model"), 0.5)
    exact = segmentations(model, "the cat")
    n = 6000
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    drawn = P.sample_texts(model, ["the cat"] * n, keys, 2)
    assert all(len({tuple(s[0]) for s in d}) == 2 and d[0][2] >= d[1][2] for d in drawn)
    assert all(abs(s[1] - exact[tuple(s[0].tolist())]) < 1e-9 for d in drawn for s in d)
    first, second = (collections.Counter(tuple(d[i][0].tolist()) for d in drawn) for i in (0, 1))
    p = {k: math.exp(v) for k, v in exact.items()}
    for k in sorted(p, key=p.get)[-5:]:
        assert abs(first[k] / n - p[k]) < 0.03
        assert abs(second[k] / n - sum(p[a] * p[k] / (1 - p[a]) for a in p if a != k)) < 0.03
    # Sums of probability over inclusion are unbiased for the total, 1.
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in d) for d in drawn]) - 1) < 0.02


def test_few_segmentations_are_all_returned():
    model = P.piece_model(tokenizer_file("piece_bpe_32k.model"), 1.0)
    exact = segmentations(model, "of")
    (own,) = P.sample_texts(model, ["of"], np.array([3], np.uint64), len(exact) + 5)
    assert {tuple(s[0].tolist()) for s in own} == set(exact)
    assert all(s[3] == 1.0 for s in own)


def test_pieces_decode_whatever_the_batches(make_docs, monkeypatch):
    docs = make_docs(list(enumerate(ODD)) + [(2, "a")])
    file = tokenizer_file("piece_bpe_32k.model")
    rows = P.sample_pieces(docs, file, k=3).collect()
    assert all(r.decodes for r in rows)
    assert {r.doc_id for r in rows} == set(range(len(ODD)))
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    monkeypatch.setattr(P, "BATCH_CHARS", 10)
    again = P.sample_pieces(docs.repartition(3), file, k=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    text = {r.doc_id: r.text for r in P.decode_pieces(P.sample_pieces(docs, file, k=1), file).collect()}
    assert text == {i: (t or "").replace("▁", " ") for i, t in enumerate(ODD)}
    assert P.sample_pieces(make_docs([]), file).collect() == []


def test_packing(make_docs):
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    rng = random.Random(1)
    rows = list(enumerate([*ODD, "it's John's. they'll ΑΣ ΣΑΣ! İ 3.14", "<|endoftext|> x"])) + [(100 + i, "word, " * rng.randrange(60)) for i in range(200)] + [(5, "again"), (None, "no id")]
    got = K.pack_documents(make_docs(rows).repartition(4), file, max_tokens=64, end_id=2, with_ids=True).collect()
    tok = Tokenizer.from_file(file)
    want = collections.Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length <= 64
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    single = {i: ids for i, ids in want if i not in (5, None)}
    for i, ids in single.items():
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == list(ids) and {r.doc_tokens for r in mine} == {len(ids)}
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert K.pack_documents(make_docs([]), file).collect() == []


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    file = tokenizer_file("word_bpe_49k.json")
    tok, words, rng = Tokenizer.from_file(file), K.WordIds(file), random.Random(12)
    signs = "aZé\u0130\u0131\u03a3\u03c3\u03c2ßŉǅﬁⅧ²٣漢ก\u0301\u0307\u0327.,'!?_-\"s10 \t\n\u00a0\u200b😀ʼ’Àa\u030a"
    texts = ["a\u0130!", "\u0130?", "\u0130_", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(20_000))]
    for text, ids in zip(texts, words(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, ascii(text)


def shortest_pack_first(histogram, size):
    """Piece by piece: longest first, into the pack with the most room."""
    packs = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        at = max(range(len(packs)), key=packs.__getitem__, default=None)
        if at is None or packs[at] < x:
            packs.append(size - x)
        else:
            packs[at] -= x
    return collections.Counter(packs)


def test_patterns_are_those_of_shortest_pack_first():
    rng = random.Random(3)
    cases = [{6: 1, 5: 1, 2: 1}, {8: 3}, {1: 50}, {3: 7, 2: 9, 1: 30}] + [{rng.randrange(1, 65): rng.randrange(1, 40) for _ in range(rng.randrange(1, 40))} for _ in range(60)]
    for histogram in cases:
        size = 8 if max(histogram) <= 8 else 64
        got = collections.Counter()
        for pattern, n in K.pack_patterns(histogram, size):
            got[size - sum(pattern)] += n
        assert got == shortest_pack_first(histogram, size)
    assert sorted(K.pack_patterns(cases[0], 8)) == [((5, 2), 1), ((6,), 1)]


def test_patterns_hold_every_piece_and_fill_up():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randrange(1, 257): rng.randrange(1, 5000) for _ in range(rng.randrange(1, 200))}
        packs = K.pack_patterns(histogram, 256)
        placed = collections.Counter()
        for pattern, n in packs:
            assert sum(pattern) <= 256 and n > 0
            for x in pattern:
                placed[x] += n
        assert placed == histogram
    big = {n: 1000 for n in range(1, 257)}
    assert sum(n for _, n in K.pack_patterns(big, 256)) * 256 < 1.02 * sum(k * v for k, v in big.items())


FOLDER = Path("/usr/share/common-licenses")
LONG = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


def licence_of(text):
    """Brute force: canonical words of a text against those of every known short text, anywhere between line ends."""
    lines = [x.split() for x in map(C.canonical_line, (text or "").split("\n")) if x]
    whole = sum(lines, [])
    known = {name: C.canonical(t).split() for name, t in C.TEXTS.items()}
    titled = whole[len(lines[0]) :] if len(lines) > 1 and " ".join(lines[0]) in C._titles() else whole
    runs = [sum(lines[i:j], []) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)]
    return next((n for n, w in known.items() if w == titled), None), ",".join(sorted({n for n, w in known.items() for r in runs if r == w and len(r) < len(whole)}))


def test_licences(make_docs):
    mit = "Copyright (c) 2020 Me\n" + C.TEXTS["MIT"].upper().replace("SUBLICENSE", "sublicence")
    spread = "MIT License\n\nCopyright (c) 2020 Me\n\n" + C.TEXTS["MIT"].replace("\n", "\n\n")
    wrapped = "\n".join(textwrap.wrap(C.TEXTS["ISC"].split("\n")[0], 72)) + "\n\n" + "\n".join(textwrap.wrap(C.TEXTS["ISC"].split("\n")[1], 72))
    rows = [
        (1, mit), (2, "Text.\nLicenced under the Apache licence, version 2.0!\nmore"), (3, "x\n\n" + C.TEXTS["ISC"] + "\n\ny"), (4, None), (5, ""), (6, "nothing"), (7, "Released under the MIT License."), (2, "other"),
        (8, "MIT License\nMIT License"), (8, "MIT License\nMIT License"), (9, spread), (10, wrapped), (11, "about us\n\n" + spread + "\n\nthe end"), (None, C.TEXTS["Zlib"]), (12, "a " * 200_000 + "\n" + wrapped), (13, C.TEXTS["MIT"] + " and more"),
        *((100 + i, t) for i, t in enumerate(C.TEXTS.values())),
    ]
    got = collections.defaultdict(list)
    for r in C.license_scan(make_docs(rows).repartition(3)).collect():
        got[r.doc_id].append((r.license, r.contains, r.notices, r.n_notices))
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        assert licence_of(t) in [x[:2] for x in got[i]], i
    assert got[1] == [("MIT", "", "", 0)] and got[9][0][:2] == ("MIT", "MIT") and got[10][0][0] == "ISC" and got[11][0][:2] == (None, "MIT")
    assert sorted(x[2:] for x in got[2]) == [("", 0), ("Apache-2.0", 1)] and got[4] == got[5] == got[6] == [(None, "", "", 0)]
    assert got[7] == [(None, "", "MIT", 1)] and got[8] == [(None, "", "MIT", 2)] * 2
    assert [got[100 + i][0][0] for i in range(len(C.TEXTS))] == list(C.TEXTS)
    assert C.license_scan(make_docs([])).collect() == []


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this machine")
def test_long_licences(make_docs):
    texts = {name: (FOLDER / file).read_text("utf-8", "replace") for file, name in LONG.items()}
    rows = [(i, t.upper()) for i, t in enumerate(texts.values())] + [(100 + i, "Some project.\n\n" + t + "\nThe end.") for i, t in enumerate(texts.values())]
    got = {r.doc_id: (r.license, r.contains) for r in C.license_scan(make_docs(rows)).collect()}
    for i, name in enumerate(texts):
        assert got[i][0] == name and got[100 + i][0] is None and name in got[100 + i][1].split(",")


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney of trigrams in dictionaries: a function of (a, b, w)."""
    seqs = [[Q.START, Q.START, *t.split(), Q.END] for t in texts]
    tri = collections.Counter(x for s in seqs for x in zip(s, s[1:], s[2:]))
    bi = collections.Counter(x[1:] for x in tri)
    uni = collections.Counter(x[1] for x in bi)

    def cuts(counts):
        n1, n2, n3, n4 = (sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))
        if not n1:
            return [0.5, 0.5, 0.5]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]

    d3, d2, d1 = cuts(tri), cuts(bi), cuts(uni)
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0.0
    total = sum(uni.values())
    unseen = sum(cut(c, d1) for c in uni.values()) / total / (len(uni) + 1)

    by_context = {}
    for counts in (tri, bi):
        for x, c in counts.items():
            by_context.setdefault(x[:-1], {})[x[-1]] = c
    sums = {x: (sum(own.values()), sum(cut(c, d3 if len(x) == 2 else d2) for c in own.values())) for x, own in by_context.items()}

    def back(context, w, d, lower):
        own = by_context.get(context)
        if own is None:
            return lower
        (t, freed), c = sums[context], own.get(w, 0)
        return (c - cut(c, d)) / t + freed / t * lower

    def p(a, b, w):
        low = max(uni.get(w, 0) - cut(uni.get(w, 0), d1), 0) / total + unseen
        return back((a, b), w, d3, back((b,), w, d2, low))

    return p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    texts = ["a b a c", "a b a b d", "c a b", "e f g h a b", "a b a c a b a b"]
    p = kneser_ney(texts)
    vocabulary = sorted({w for t in texts for w in t.split()}) + [Q.END, "never seen"]
    for a, b in [(Q.START, Q.START), ("a", "b"), ("zz", "b"), ("zz", "yy"), ("f", "g")]:
        assert sum(p(a, b, w) for w in vocabulary) == pytest.approx(1)
    deltas, unseen = Q.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    asked = [*texts, "", "zz yy b a", "a a a a", "b", "c a b a c " * 50, "q " * 3000, "a b a c"]
    rows = spark.createDataFrame([(i, i % 7, t) for i, t in enumerate(asked)], "key long, key2 long, text string")
    want = {}
    for i, t in enumerate(asked):
        s = [Q.START, Q.START, *t.split(), Q.END]
        want[i] = (len(s) - 2, -sum(math.log(p(*x)) for x in zip(s, s[1:], s[2:])) / (len(s) - 2))
    for groups in (10**9, 100):
        monkeypatch.setattr(Q, "GROUP_CHARS", groups)
        got = {r.key: (r.n_words, r.nll) for r in Q.score_texts(rows.union(rows).repartition(3), deltas, unseen).collect()}
        assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
        assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-9) for i in want)


def test_quality_on_held_out_labels(spark, make_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality_verdicts(docs, labels).join(labels, "doc_id").select("keep", "quality").collect()
    share = lambda q, keep: sum(r.keep == keep for r in rows if r.quality == q) / sum(r.quality == q for r in rows)
    assert share(1, True) > 0.99 and share(0, False) > 0.6
    kept = Q.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    odd = make_docs(list(enumerate(ODD)) + [(None, "null id"), (2, "a")])
    assert Q.quality_verdicts(odd, labels).count() == len(ODD) + 2
    assert Q.quality_verdicts(make_docs([]), labels).collect() == []
    assert Q.quality_filter(odd.withColumn("lang", F.lit(None).cast("string")), labels.limit(0)).count() >= len(ODD)


def test_copies_move_no_threshold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.where("lang = 'fr' AND length(text) > 0").collect()
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.text: r.doc_id for r in rows}
    good = [t for t, i in texts.items() if i in trusted]
    base = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1) for i, t in enumerate(texts) if t in set(good)] + [(i, 1) for i in range(10_000, 14_000)], "doc_id long, quality int")
    copies = spark.createDataFrame([(10_000 + i, good[0], "fr") for i in range(4 * len(texts))], base.schema)
    keep = lambda d: {r.doc_id: r.keep for r in Q.quality_verdicts(d, marks).where("doc_id < 10000").collect()}
    alone, crowded = keep(base), keep(base.union(copies))
    assert crowded == alone and sum(alone.values()) > len(alone) / 2
    sample = Q.training_sample(base.union(copies), marks, folds=1).collect()
    assert len(sample) == len(good)


def test_training_words_are_dealt_to_languages(spark):
    rows = [(i, f"en {i} " + "word " * 20, "en") for i in range(500)] + [(1000 + i, f"fr {i} " + "mot " * 20, "fr") for i in range(20)] + [(2000, "long " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int")
    got = [r.text for r in Q.training_sample(docs, labels, folds=1, max_words=2000).collect()]
    assert sum(t.startswith("fr") for t in got) == 20  # 460 words: the smaller language takes part whole
    assert max(len(t.split()) for t in got) == 2000 // Q.LONGEST_SHARE and 1800 <= sum(len(t.split()) for t in got) < 2100


PAGE = "<html><head><title>t</title><script>var a = '<p>no</p>'; if (1<2) x(\"y</b\")</script></head><body class='with-sidebar'><nav><a href=/>Menu</a></nav><div class=\"cookie-notice\">Accept</div>{}<aside>side</aside><footer>f</footer></body></html>"


def test_pages(spark):
    article = "<article class='post-{i}'><h1>Title {i}</h1><p>Some <b>bo</b>ld&nbsp;text &amp; more.<br>Next <p>open<ul><li>one<li>two</ul><!-- c --><form><p>mail</form><div class='share-links'>tweet</div></article><div class=comments><p>first!</p></div>"
    rows = [(i, f"http://a.org/{i}", PAGE.format(article.format(i=i))) for i in range(5)]
    rows += [(10, "http://a.org/x", "<p>no article here"), (11, None, None), (12, "http://b.org/", ""), (13, "http://c.org", "<div id=main-3><p>long text of the page, really</p></div><div><a href=x>links links links links links</a></div>"), (14, "http://c.org", "<script>never closed <p>x"), (14, "http://c.org", "a < b &lt;i&gt; c")]
    got = collections.defaultdict(set)
    for r in H.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == {f"Title {i} Some bold text & more. Next open one two"} for i in range(5))
    assert got[10] == {"no article here"} and got[11] == got[12] == {""}
    assert got[13] == {"long text of the page, really"}
    assert got[14] == {"", "a < b <i> c"}


def test_pages_that_would_take_long():
    """Deep nesting, tags and quotes that never end: time and memory grow with the page, not with its square."""
    deep = "<div class=a>" * 40_000 + "<p>the text</p>"
    began = time.process_time()
    for source in (deep, "<a " * 100_000 + "x", '<a ">" ' * 60_000, "<a '\"" * 60_000 + ">", "<div>" * 20_000 + "</p>" * 20_000, "<blockquote>" * 20_000 + "<li>a" * 20_000, "<article>" * 20_000 + "<header>h</header>" * 2000, "<!" * 100_000, "&amp" * 100_000):
        page = H.Page(source)
        page.text(H.best_path(page.scores()))
    assert time.process_time() - began < 20
    page = H.Page(deep)
    assert page.text(H.best_path(page.scores())) == "the text"
    assert H.Page("a<img src=x>b <b>c</b>d").text(None) == "ab cd"


def test_page_rows(spark):
    rows = [(None, "http://a.org/1", "<p>null id</p>"), (None, None, None), (7, "http://a.org/2", "<p>" + "long text " * 100_000)]
    got = {(r.page_id, r.url): r.n_chars for r in H.extract_pages(spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, path string, host string")).collect()}
    assert got == {(None, "http://a.org/1"): 7, (None, None): 0, (7, "http://a.org/2"): 999_999}
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_wrappers_named_after_the_layout(spark):
    article = "<article><p>The article of this page.</p><div class=share>tweet</div></article><div class=sidebar><p>side</div><div class='comments'><article>I say</article></div>"
    rows = [
        (1, "http://a.org/1", f"<body><div class='layout with-sidebar'>{article}</div></body>"),
        (2, "http://b.org/1", f"<div id='page' class='site no-comments'><div class=related-posts><main>{article}</main></div></div>"),
        (3, "http://c.org/1", "<p>Site</p><div class='site no-comments'><div><p>A page without an article element, long enough.</p></div><div class=sidebar>s</div></div>"),
        (4, "http://d.org/1", "<div><p>Some text of the page itself.</div><div class=comments><p>And some comments, a bit longer than that text is.</div>"),
    ]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "The article of this page."
    assert got[3] == "A page without an article element, long enough." and got[4] == "Some text of the page itself."


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_urls(spark):
    link = "<head><link href='{}' rel='canonical'></head>"
    rows = [
        (1, "http://x.example.org/es/a", None), (2, "HTTP://EXAMPLE.ORG/en/12?q#f", ""), (3, "http://a.com/de/x", link.format("http://z.net/1")), (4, "https://z.net/1#top", None),
        (5, "http://y.net/p", link.format("//z.net/1")), (6, "http://w.net/a/b", "<meta http-equiv=refresh content='0; url=/c'>"), (7, "http://w.net/c", None), (8, None, None), (9, "no scheme", None),
        (10, "http://q.net/", link.format("http://a.com/fr/x")), (11, "http://q.net/2", link.format("http://q.net/") + "<meta http-equiv='refresh' content='5;URL=http://a.com/de/y'>"), (12, "http://org", None), (13, "http://notexample.org/es/", None), (1, "http://x.example.org/es/a", None),
        (14, "http://r.net/a/b/c", link.format("../../d?x=1")), (15, "http://r.net/d?x=1", link.format("http://s.net/no") + link.format("http://a.com/de/second")), (None, "http://u.net/", "x" * 500_000 + link.format("http://a.com/de/long")), (16, "http://v.net/" + "p" * 100_000, None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.url_verdicts(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string"), RULES).collect()}
    assert got[1] == ("x.example.org", "/es/a", "example.org/es/", "block") and got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.com", "/de/x", "com/de/", "block")
    assert got[4] == ("z.net", "/1", None, "block") and got[5][3] == "block"  # aliases of a blocked page
    assert got[6][3] == got[7][3] == "allow" and got[8] == ("", "", None, "allow") == got[9]
    assert got[10][3] == "allow" and got[11][3] == "allow"  # an explicit allow among the aliases wins
    assert got[12] == ("org", "", None, "allow") and got[13][2] == "org/"
    assert got[14][3] == got[15][3] == got[None][3] == "block" and got[16][3] == "allow" and len(got[16][1]) == 100_001
    assert U.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string"), RULES).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:330] = x[5]  # a group of copies larger than a result
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [float("inf")] * 16), (None, [1.0] * 16), (20, x[20].tolist())]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], "vec_id long, embedding array<float>, q int")
    got = collections.defaultdict(list)
    for r in N.nearest(table, F.col("vec_id") % 20 == 0, neighbours=16, pool=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hit, wide = 0, x.astype(float)
    for q, own in got.items():
        s = (wide * wide[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        hit += len({v for v, _ in own} & set(want.tolist()))
        assert len(own) == 20 and all(abs(s[v] - score) < 1e-9 for v, score in own)
        assert own == sorted(own, key=lambda r: (-r[1], r[0]))
    assert hit / (20 * len(got)) > 0.95
    mixed = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0]), (2, [2.0]), (3, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in N.nearest(mixed, F.col("vec_id") == 1).collect()] == [(3, 2.5), (2, 2.0)]
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 4)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in N.nearest(few, F.col("vec_id") == 2).collect()] == [(2, 1, 3), (2, 2, 1)]
    assert N.nearest(few.limit(0), F.col("vec_id") == 2).collect() == []


def test_recall_with_unequal_norms_and_an_outlier(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 24)) * np.exp(rng.normal(size=(3000, 1)) * 0.7)
    x[77] *= 1000
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in N.nearest(table, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].add(r.vec_id)
    scores = x[::20] @ x.T
    scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    assert sum(len(found[20 * i] & set(b.tolist())) for i, b in enumerate(best)) / best.size >= 0.9


