"""The operators against brute force, exact round trips and edge cases."""

import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import ann, common, cotraining, html_text, language_model, line_dedup, minhash, mixing, pieces, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i % 3}"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(n))


# components ---------------------------------------------------------------------------------------------


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(10, 41)) and all(got[i] == 100 for i in range(100, 140)) and 7 not in got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 neighbours -------------------------------------------------------------------------------------------


def test_hilbert_keys_are_a_path(spark):
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_match_brute_force_with_bad_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[41:60] = x[40]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, "x"), (1020, [0.0] * 8, "x"), (1040, [float("nan")] * 8, "x"), (1060, [float("inf")] * 8, "x"), (1080, [1.0, None] * 4, "x"), (1100, [1.0], "x"), (40, x[40].tolist(), "again")]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(float)
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        want = sorted((-float(sum(a * b for a, b in zip(x[q], x[i]))), i) for i in range(300) if i != q)[:5]
        assert [(r, i) for r, i, _ in sorted(found)] == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_with_small_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann.search(df, k=10, block=128, most=512).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s, kind="stable")[:10].tolist()))
    assert hits / (200 * 10) >= 0.9


# 2 main text --------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>A   title &amp; more</h1><p><b>First
 paragraph of the text, long enough to count.<br><p>Second &copy; one, with several more words in it.<p>ok</article>
<aside>Aside text that is long enough to be taken for content by its length alone.</aside>
<section id=comments><p>A reader's comment that is quite long, and full of words too.</section>
<form><label>Name</label></form><footer>&copy; someone</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "A title & more\nFirst paragraph of the text, long enough to count.\nSecond © one, with several more words in it.\nok"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("<div>" * 5000 + "deep", "deep"), ("</p></div>x<b", "x"), ("<nav>menu</nav>", "")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


LONG = "A paragraph of the article with enough words in it to be seen as text of its own right."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<body><nav>menu</nav><form action=x><div><h2>Name</h2><p>{LONG}<p>{LONG}</div></form><footer>f</footer></body>", f"Name\n{LONG}\n{LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section id='discussion'><h2>D</h2><p>{LONG}</p></section></article><div class='comments'><p>{LONG}</p></div>", f"T\n{LONG}\nD\n{LONG}"),
        (f"<body><div class='ad-free content'><p>{LONG}</p><p>ok</p></div><div class='ad'>{LONG}</div></body>", f"{LONG}\nok"),
        (f"<body><div class='post-header-body'><p>{LONG}</p></div><div class='sidebar'>short</div></body>", LONG),
        (f"<body><div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div><article><p>Short.</p></article></body>", "Short."),
        ("<article>" + "<div>" * 300 + f"<p>{LONG}</p>" + "</div>" * 300 + "<p>End.</p></article><div class=ad>x</div>", f"{LONG}\nEnd."),
        ("<span>" * 6000 + "<nav>" + "<i>" * 6000 + "hidden" + "</i>" * 6000 + "</nav>" + f"<p>{LONG}</p>", LONG),
    ],
)
def test_marks_yield_to_the_mass_of_text(page, text):
    assert html_text.main_text(page) == text


def test_ratios_decide_what_no_mark_tells():
    blurb = "<div><a href=x>one</a> <a href=y>two</a> <a href=z>three</a> <a href=w>four</a></div>"
    page = f"<body>{blurb}<div>{''.join(f'<p>{LONG}</p>' for _ in range(6))}</div>{blurb}</body>"
    assert html_text.main_text(page) == "\n".join([LONG] * 6)
    parser = html_text.Lines()
    parser.feed(page)
    lines = parser.finish()
    found = html_text.ratios(lines, html_text.unmarked(lines, parser.marked_in))
    assert found[1] == len(LONG) / lines[1].tags and found[0] < 2


def test_smoothing_and_threshold_against_loops():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40):
        x = rng.integers(0, 300, n).astype(float)
        w = [[np.exp(-0.5 * (i - j) ** 2) if abs(i - j) <= 3 else 0.0 for j in range(n)] for i in range(n)]
        want = [sum(a * b for a, b in zip(row, x)) / sum(row) for row in w]
        assert np.allclose(html_text.smoothed(x, 1.0), want)
    assert 1 < html_text.threshold(np.array([0.0, 0.5, 1.0, 30.0, 35.0, 28.0])) < 28
    assert html_text.threshold(np.array([500.0, 700.0, 5000.0])) == 40


def test_extract_keeps_every_row(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "<p>" + "word " * 50_000)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert max(r["n_chars"] for r in out) == 5 * 50_000 - 1


# 3 mixing -----------------------------------------------------------------------------------------------


def water(sizes, weights, total):
    out, open_ = {}, list(range(len(sizes)))
    while True:
        w = sum(weights[i] for i in open_)
        left = total - sum(out.values())
        over = [i for i in open_ if left * weights[i] / w > 2 * sizes[i]]
        if not over:
            return [out.get(i, left * weights[i] / w if i in open_ else 0) for i in range(len(sizes))]
        out |= {i: 2.0 * sizes[i] for i in over}
        open_ = [i for i in open_ if i not in over]


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(4)
    names = [None, "b", "a", "é", "Z"]
    rows = [(i, " ".join(["x"] * max(1, int(rng.paretovariate(1.2)) % 300)), "en", rng.choice(names + ["a"] * 4), 0) for i in range(1500)]
    rows += [(5000, None, "en", "a", 0), (5001, "", "en", None, 0), (7, rows[7][1], "en", rows[7][3], 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.report(df).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    order = ["Z", "a", "b", "é", None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in order]
    want = water(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))
    for s, size, target in zip(order, sizes, want):
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == size and abs(mine[0]["target"] - target) < 1e-6 * target
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine)
    again = mixing.report(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = mixing.repeated(df)
    assert copies.columns == df.columns and copies.count() == sum(r["copies"] for r in got)
    assert mixing.report(df.limit(0)).count() == 0


def test_pivot_keeps_words_and_is_unbiased():
    rng = np.random.default_rng(0)
    size, total = np.array([5.0, 3.0, 8.0, 1.0, 2.0]), np.zeros(5)
    for _ in range(4000):
        p = np.full(5, 0.4)
        i = mixing.pivot(size, p, iter(rng.random(10)))
        assert abs((p * size).sum() - 0.4 * size.sum()) < 1e-9 and sum(0 < x < 1 for x in p) <= 1 and (i < 0 or 0 < p[i] < 1)
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.03


# 4 language model ---------------------------------------------------------------------------------------


def test_language_model_counts_base_and_sums_to_one(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60), 80) for _ in range(200)] + [None, "", "  \n ", "A a É é"]
    got = {r["doc_id"]: r for r in language_model.score(docs_of(spark, texts), head=20).collect()}
    assert len(got) == len(texts)
    toks = [[w.decode() for w in common.words(t)] + ["<end>"] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(w in c for w in t), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6
        assert r["score"] < 0
    w, bias = np.random.default_rng(0).normal(size=(language_model.ROWS, language_model.CLASSES)).astype(np.float32), np.zeros(language_model.CLASSES, np.float32)
    p = language_model.probabilities(w, bias, np.array([[1, 2, 3], [4, 5, 6]], np.uint16))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_language_model_learns_context(spark):
    rng = random.Random(5)
    # words of two kinds that follow one another in runs: context tells, counts don't
    texts = [" ".join(rng.choice(["aaa", "abb"] if k else ["zzz", "zyy"]) + str(rng.randint(0, 30)) for k in [i % 2] for _ in range(120)) for i in range(400)]
    got = [r for r in language_model.score(docs_of(spark, texts)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) * 0.98
    assert language_model.score(docs_of(spark, ["x"]).limit(0)).count() == 0


def test_word_beginnings_fall_into_more_than_16_classes():
    kinds = {language_model.class_of(f"{a}{b}".encode(), {str(i).encode(): i for i in range(16)}) for a in "abcdefghijklmnopqrstuvwxyz" for b in range(10)}
    assert kinds == set(range(language_model.OWN, language_model.CLASSES)) and language_model.CLASSES >= 32
    assert language_model.class_of(b"the", {b"the": 3}) == 3


# 5 line dedup -------------------------------------------------------------------------------------------


def slow_edit(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        d, last = [i], d
        for j, b in enumerate(y, 1):
            d.append(min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (a != b)))
    return d[-1]


def test_edit_distance_is_exact_within_its_bound():
    rng = random.Random(9)
    for _ in range(600):
        x = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        y = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        most = rng.randint(0, 6)
        assert line_dedup.edit_distance(x, y, most) == min(slow_edit(x, y), most + 1)


def test_word_hashes_depend_on_the_word_alone():
    words = [b"a", b"b", b"ab", b"ba", b"a" * 70_000, b"a" * 70_001, "größe".encode(), b"a", b"0", b"00"]
    found = line_dedup.word_hashes(b" ".join(words))
    assert [int(x) for x in found] == [int(line_dedup.word_hashes(w)[0]) for w in words]
    assert len(set(found.tolist())) == len(set(words))


def test_line_dedup_removes_exact_and_fuzzy_repeats(spark):
    rng = random.Random(6)
    base = [prose(rng, 60) for _ in range(30)]
    changed = base[0].split()
    changed[30] = "other"
    texts = ["\n".join(base[:5]), "intro line of its own\n" + base[1].upper() + "!\n" + base[10], " ".join(changed) + "\n" + base[11], None, "", "\n\n", base[12] + "\n" + base[12], base[5]]
    got = {r["doc_id"]: r for r in line_dedup.report(docs_of(spark, texts)).collect()}
    removed = {i: r["n_removed"] for i, r in got.items()}
    assert {i: removed[i] for i in (0, 1, 3, 4, 5, 6, 7)} == {0: 0, 1: 1, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}
    assert removed[2] == 1
    kept = line_dedup.keep_first(docs_of(spark, texts + [base[7], base[7]]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_parities_flip_two_bits_an_edit_at_most():
    rng = random.Random(4)
    for _ in range(200):
        x = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        y = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] if rng.random() < 0.5 else x[: rng.randint(1, len(x))]
        h = line_dedup.word_hashes(" ".join(x + y).encode())
        flips = sum((int(p.view(np.uint64)[0]) ^ int(p.view(np.uint64)[1])).bit_count() for p in line_dedup.parities(h, np.array([0, len(x)])))
        assert flips <= 2 * slow_edit(x, y)


def test_within_is_exact():
    rng = random.Random(14)
    for _ in range(1500):
        x = [rng.choice("abcdef") for _ in range(rng.randint(0, 14))]
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 1)] = rng.choice([[], ["z"], ["a", "b"]])
        most = rng.randint(0, 6)
        assert line_dedup.within(x, y, most) == (slow_edit(x, y) <= most)


def test_lines_are_normalised_as_their_words_are():
    text = " A  b\t\x0bC- 12 \r\n\n - \nx -- y\x0c. z \u00a0\u2028w\n!"
    assert line_dedup.normal_lines(text) == [b" ".join(line_dedup.normal_words(x.encode())) for x in text.split("\n")]
    assert line_dedup.normal_lines(None) == [b""]


def test_wide_parities_flip_two_bits_an_edit_at_most_and_tell_long_lines_apart():
    rng = random.Random(5)
    for n in (129, 150, 255, 257, 500, 520, 1030, 3000):
        x = [f"w{int(900 * rng.random() ** 2)}" for _ in range(n)]
        y, edits = list(x), rng.randint(1, n // 5)
        for _ in range(edits):
            at = rng.randrange(len(y))
            y[at : at + 1] = rng.choice([[], ["new", y[at]], ["new"]])
        z = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        h = line_dedup.word_hashes(" ".join(x + y + z).encode())
        long, found = line_dedup.wide_parities(h, np.array([0, n, n + len(y)]))
        found = dict(zip(long.tolist(), found))

        def flips(a, b):
            a, b = sorted((a, b), key=len)
            while len(b) > len(a):
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            return sum((int(u) & (2**64 - 1)).bit_count() for u in a ^ b)

        assert 0 in found and 2 in found and len(found[0]) * 64 >= 4 * n
        if 1 in found:
            assert flips(found[0], found[1]) <= 2 * edits
        assert flips(found[0], found[2]) > 2 * (n // 5)


def test_line_dedup_verifies_few_pairs_of_long_lines_that_share_a_passage(spark, monkeypatch):
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage = words(60)
    lines = [f"{words(n // 2)} {passage} {words(n - n // 2)}" for n in (340,) * 60 + (1940,) * 60]
    near = lines[70].split()
    for i in range(0, 1900, 9):
        near[i] = "other"
    verified, before = spark.sparkContext.accumulator(0), line_dedup._confirm

    def counted(least):
        run = before(least)

        def each(batches):
            def passed():
                for pdf in batches:
                    verified.add(len(pdf))
                    yield pdf

            return run(passed())

        return each

    monkeypatch.setattr(line_dedup, "_confirm", counted)
    got = line_dedup.repeats(docs_of(spark, ["\n".join(lines[:60]), "\n".join([*lines[60:], " ".join(near)])])).collect()
    assert [(r["doc_id"], r["line"]) for r in got] == [(1, 60)]
    assert verified.value <= 5 * len(lines)


def test_line_dedup_finds_nearly_all_lines_of_edit_similarity_08(spark):
    rng = random.Random(12)
    lines = []
    for n in [*range(1, 25), 30, 40, 60, 100, 200] * 6:
        x = [f"{chr(97 + rng.randrange(26))}{prose(rng, 1)}{chr(97 + rng.randrange(26))}" for _ in range(n)]
        y = list(x)
        for _ in range(n // 5):
            at = rng.randrange(len(y))
            y[at : at + 1] = rng.choice([[], [y[at], "new"], ["new"], ["new"]])
        lines += [" ".join(x), " ".join(y)]
    words = [line_dedup.normal_words(x.encode()) for x in lines]
    wanted = [(i, j) for i in range(len(words)) for j in range(i) if 5 * abs(len(words[i]) - len(words[j])) <= max(map(len, (words[i], words[j]))) and line_dedup.edit_distance(words[i], words[j], k := max(len(words[i]), len(words[j])) // 5) <= k]
    assert len(wanted) > 150
    comp = {r["line"]: r["comp"] for r in line_dedup.repeats(docs_of(spark, ["\n".join(lines)])).collect()}
    found = sum(i in comp and comp.get(j, comp[i]) == comp[i] for i, j in wanted)
    assert found >= 0.98 * len(wanted)
    assert set(comp) <= {i for pair in wanted for i in pair}


def test_line_dedup_report_is_that_of_a_double_loop(spark):
    rng = random.Random(21)
    pool = [prose(rng, rng.choice([1, 2, 5, 6, 9, 14, 20, 40]), 5000) for _ in range(60)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(pool).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(["new", "Word!", "7"])
            lines.append(rng.choice(["", " "]) + " ".join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "?!\n?!", "x " * 30_000 + "\n" + "y " * 30_000]
    lines = [(d, i, line_dedup.normal_words(x.encode())) for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, x) in enumerate(lines):
        for j in range(i):
            y = lines[j][2]
            most = max(len(x), len(y)) // 5
            if find(i) != find(j) and abs(len(x) - len(y)) <= most and len(x) < 1000 and slow_edit(x, y) <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    gone = {lines[i][:2] for i in range(len(lines)) if find(i) != i}
    docs = docs_of(spark, texts).withColumn("line", F.lit(1)).withColumn("_mq_gone", F.lit("kept")).withColumn("gone", F.lit(2))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t is not None else None for d, t in enumerate(texts)}
    out = line_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "_mq_lines", "_mq_removed"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert {d: r["text"] for d, r in got.items()} == want and all(r["_mq_gone"] == "kept" for r in got.values())
    again = {r["doc_id"]: (r["n_removed"], r["n_chars_kept"]) for r in line_dedup.report(docs).collect()}
    assert again == {d: (sum(g[0] == d for g in gone), len(want[d] or "")) for d in want}


def test_line_dedup_of_nothing_of_a_chain_and_of_repeated_rows(spark):
    empty = docs_of(spark, ["a"]).limit(0)
    assert line_dedup.report(empty).count() == 0 and line_dedup.keep_first(empty).columns == empty.columns
    rng = random.Random(3)
    words = [f"q{rng.randrange(10**6)}" for _ in range(300)]
    drift = [" ".join(words[i : i + 20]) for i in range(0, 240, 2)]  # each line is near the next only
    order = rng.sample(range(len(drift)), len(drift))
    got = line_dedup.report(docs_of(spark, [drift[i] for i in order])).collect()
    assert sum(r["n_removed"] for r in got) == len(drift) - 1 and min(r["doc_id"] for r in got if not r["n_removed"]) == 0
    twice = spark.createDataFrame([(5, "one two three\nfour five six"), (5, "one two three\nfour five six"), (7, "four five six"), (None, "four five six")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in line_dedup.report(twice).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (7, 1)]


# 6 pieces -----------------------------------------------------------------------------------------------

needs_vocabulary = pytest.mark.skipif(not pieces.available(), reason="needs the vocabulary file")


def best_score(tok, unit):
    v = tok.vocabulary
    known = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k in (pieces.NORMAL, pieces.USER)}
    text = unit.decode()
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        best[i + 1] = max(best[i + 1], best[i] + tok.unknown_score)
        for j in range(i + 1, len(text) + 1):
            s = known.get(text[i:j].encode())
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@needs_vocabulary
def test_viterbi_finds_the_best_score_and_round_trips(spark):
    tok = pieces.tokenizer(pieces.VOCABULARY)
    texts = ["", "a", " two  spaces ", "Hello, world!\nnew\tline", "Straße ñandú 漢字 😀 ́", "x" * 300, "▁mark", None, "thhe ingle oned " * 40]
    out = {r["doc_id"]: r for r in pieces.encode(docs_of(spark, texts)).collect()}
    assert all(r["round_trip"] for r in out.values()) and out[0]["ids"] == [] and out[7]["n_tokens"] == 0
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs_of(spark, texts))).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    units = [u for t in texts if t for u in pieces._UNIT.findall(pieces.marked(t))]
    for u, ids in zip(units, tok.viterbi(units)):
        plain = [i for i in ids if tok.vocabulary.kinds[i] != pieces.BYTE]
        unknown = sum(0x80 > b or b >= 0xC0 for i in ids if tok.vocabulary.kinds[i] == pieces.BYTE for b in tok.surface[i])
        assert abs(tok.vocabulary.scores[plain].sum() + unknown * tok.unknown_score - best_score(tok, u)) <= 1e-6 * abs(best_score(tok, u)) + 1e-6


@needs_vocabulary
def test_units_of_any_bytes_walk_the_trie_together():
    rng = random.Random(15)
    tok = pieces.tokenizer(pieces.VOCABULARY)
    units = [b"", b"\x80", b"\x00", b"a\x00b"] + [bytes(rng.choice(b"the and ing\x80\xc3\xa9\xe6\xbc\xa2\xf0\xff\x00") for _ in range(rng.randint(1, 140))) for _ in range(600)]
    flat, sizes = tok.segment(units)
    at = np.append(0, np.cumsum(sizes))
    assert [flat[x:y].tolist() for x, y in zip(at, at[1:])] == [tok._one(u) for u in units] == tok.viterbi(units)
    assert [r.decode("utf-8", "replace") for r in tok.decode_rows(flat, at)] == [tok.decode(flat[x:y].tolist()) for x, y in zip(at, at[1:])]
    walked, step = [], tok.trie.step
    tok.trie.step = lambda state, byte: walked.append(len(state)) or step(state, byte)
    try:
        tok.segment([u for u in units if len(u) <= 96])
    finally:
        del tok.trie.step
    assert len(walked) <= tok.longest + 1


@needs_vocabulary
def test_encoder_mixes_plain_and_odd_texts_and_forgets_units():
    import pyarrow as pa

    rng = random.Random(16)
    tok = pieces.tokenizer(pieces.VOCABULARY)
    texts = ["".join(rng.choice(["a", "the", "ing", " ", " ", "  ", "\n", "é", "▁", "\x00"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    enc = pieces.BatchEncoder(tok, 40)
    for lo in range(0, 400, 20):
        ids, at = enc(pa.array([t.encode() for t in texts[lo : lo + 20]], pa.binary()))
        want = [[i for u in pieces._UNIT.findall(pieces.marked(t)) for i in tok._one(u)] for t in texts[lo : lo + 20]]
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == want
    assert len(enc.number) < 200


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(8)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    trie = pieces.DoubleArray(keys, list(range(len(keys))))
    for n in range(1, 5):
        for word in map(bytes, itertools.product(b"abcd", repeat=n)):
            s = np.array([0])
            for c in word:
                s = trie.step(s, np.array([c]))
                if s[0] < 0:
                    break
            found = int(trie.value[s[0]]) if s[0] >= 0 else -1
            assert found == (keys.index(word) if word in keys else -1)


# 7 quality rules ----------------------------------------------------------------------------------------


def slow_statistics(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_statistics_match_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a a", "x\nx\n\nx \ny", "é É 漢 | <b> #$%&*\x0b\x0cz", "nb sp"]
    texts += ["\n".join(prose(rng, rng.randint(0, 15), 6) for _ in range(rng.randint(1, 8))) for _ in range(60)] + [prose(rng, 20_000, 3000)]
    got = {r["doc_id"]: r for r in quality_rules.report(docs_of(spark, texts), spark.createDataFrame([], LABELS)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], slow_statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t)
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_rules_learn_junk_and_keep_clean_documents(spark):
    rng = random.Random(1)
    good = [prose(rng, 120, 5000) for _ in range(120)]
    junk = [" ".join(w + "$$$" for w in prose(rng, 120, 5000).split()) for _ in range(60)] + [prose(rng, 120, 5000).upper() + " !!!" * 40 for _ in range(60)]
    docs = docs_of(spark, good + junk).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], LABELS)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.report(docs, labels).collect()}
    assert all(got[i] for i in range(120)) and sum(got[i] for i in range(120, 240)) <= 3
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


# 8 and 9 classifiers ------------------------------------------------------------------------------------


def test_cotraining_keeps_clean_documents(spark):
    rng = random.Random(2)
    texts = [prose(rng, 80, 900) if i % 4 else prose(rng, 80, 900).upper() + "!!" * 30 for i in range(400)] + [None, ""]
    docs = docs_of(spark, texts, {i: "bad.example" if i % 4 == 0 and i % 3 else "fine" for i in range(400)}).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(401, None, None)], LABELS)
    got = {r["doc_id"]: r["kept"] for r in cotraining.score(docs, labels).collect()}
    assert len(got) == 402 and sum(got[i] != (i % 4 > 0) for i in range(400)) <= 8
    assert all(r["kept"] for r in cotraining.score(docs, labels.limit(0)).collect())


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    x = rng.normal(size=(1200, 4)) + 3 * y[:, None]
    z = rng.normal(size=(1200, 3)) + 2 * y[:, None]
    known = np.where(np.arange(1200) < 200, y, -1)
    model = cotraining.CoTrained().fit(x, z, known)
    assert model.taught > 50 and ((model.scores(x, z)[2] >= 0.5) == y).mean() > 0.97


def test_every_unlabelled_row_can_be_picked(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 9000)
    x = (rng.normal(size=(9000, 4)) + 3 * y[:, None]).astype(np.float32)
    z = (rng.normal(size=(9000, 3)) + 2 * y[:, None]).astype(np.float32)
    known = np.where(np.arange(9000) < 500, y, -1)
    rows = [(i, a.tolist(), b.tolist(), int(k)) for i, (a, b, k) in enumerate(zip(x, z, known))]
    model = cotraining.train(spark.createDataFrame(rows, "doc_id long, text array<float>, meta array<float>, y int"))
    pool = cotraining.CoTrained().fit(x[:6500], z[:6500], known[:6500])
    assert model.taught > 1.3 * pool.taught
    assert ((model.scores(x, z)[2] >= 0.5) == y).mean() > 0.97


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    texts = [prose(rng, 60, 300) + (" you " + rng.choice(["idiot", "scum", "clown"]) + " " + prose(rng, 20, 300) if i % 5 == 0 else "") for i in range(600)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(600)], LABELS)
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, texts), labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(600)) and len(got) == 602
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.95
    assert all(r["score"] == 0 for r in toxicity.score(docs_of(spark, texts), labels.limit(0)).collect())


def test_machine_learns_a_pair_that_no_sum_tells():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        docs.append(np.array([t for t, on in ((0, a), (1, b), (2, not a), (3, not b)) if on]))
        y.append(float(a == b))
    m = toxicity.Machine(4, factors=4, seed=2).fit(docs, np.array(y), epochs=60, decay=0.0)
    ends = np.cumsum([len(d) for d in docs])
    assert ((m.score(np.concatenate(docs), ends) > 0.5) == np.array(y)).mean() > 0.95


# 10 near-duplicates -------------------------------------------------------------------------------------


def slow_components(texts, width=5, percent=80):
    sets = []
    for t in texts:
        w = common.words(t)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = comp[a], comp[b]
            comp = [min(x, y) if c in (x, y) else c for c in comp]
    return comp, [len(s) for s in sets]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        base = prose(rng, rng.randint(30, 200)).split()
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 40)}"
            texts.append(" ".join(copy))
    hot = prose(rng, 150).split()
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(150)] = f"h{rng.randint(0, 9)}"
        texts.append(" ".join(copy))
    df = docs_of(spark, texts).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    comp, sizes = slow_components(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == sum(i == c for i, c in enumerate(comp))


def test_near_duplicates_without_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == [(4, 4, True), (4, 4, True), (None, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_circulant_signature_is_the_shifted_minimum():
    s = minhash.shingle_set(np.arange(1, 400, dtype=np.uint64), 3)
    bins = (common.mix64(s) >> np.uint64(44)).astype(int)
    pi = minhash._shifts(128)[:, 0]
    sig = minhash.signature(s)
    assert all(sig[k] == min(pi[(b + k) % minhash.BINS] for b in bins) for k in (0, 1, 77, 127))


# pipeline -----------------------------------------------------------------------------------------------


@needs_vocabulary
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = common.read(spark, d, "documents")
    columns, seen = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        docs = common.stored(stage(spark, docs, d))
        seen.append(docs.count())
        assert i == len(p.STAGES) - 1 or docs.columns == columns
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0 and seen[5] == seen[4] > 0
    assert p.run(spark, d).count() == seen[5]


def test_pipeline_stages_do_what_their_operators_say(spark):
    import corpus_pipeline as p

    stages, rng = dict(p.STAGES), random.Random(8)
    base = [" ".join("".join(rng.choices("abcdefghijklmno", k=5)) for _ in range(90)) for _ in range(8)]
    near = base[0].split()
    near[45] = "changed"
    texts = [base[0], " ".join(near), base[1] + "\n" + base[2], base[2] + "\n" + base[3], "too short", None, "", base[4], base[4]] + base[5:]
    docs, labels = docs_of(spark, texts), "/root/testdata/sf0.001"
    good = stages["quality rules"](spark, docs, labels)
    assert {r["doc_id"] for r in good.collect()} <= set(range(len(texts))) - {4, 5, 6}
    lines = {r["doc_id"]: r["text"] for r in stages["line dedup"](spark, docs, "").collect()}
    assert lines[0] == base[0] and 1 not in lines and lines[3] == base[3] and 8 not in lines and lines[5] is None and lines[6] == ""
    first = {r["doc_id"] for r in stages["near-duplicates"](spark, docs, "").collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set() for t in texts]
    linked = {j for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert first == set(range(len(texts))) - linked
    taken = Counter(r["doc_id"] for r in stages["mixing"](spark, docs, "").collect())
    assert taken == {r["doc_id"]: r["copies"] for r in mixing.report(docs).collect() if r["copies"]}
    nothing = docs.limit(0)
    for name in ("quality rules", "line dedup", "near-duplicates", "mixing"):
        out = stages[name](spark, nothing, labels)
        assert out.columns == docs.columns and out.count() == 0


@needs_vocabulary
def test_pipeline_decodes_what_it_encodes(spark):
    import corpus_pipeline as p

    out = dict(p.STAGES)["token ids"](spark, docs_of(spark, ["some  text", "Straße 漢", None]), "").collect()
    assert len(out) == 3 and all(r["round_trip"] for r in out)


def test_samples_and_frequent_words_by_threshold(spark):
    ids = spark.range(20_000)
    assert {r[0] for r in common.sample_by_hash(ids, "id", 500, 3).collect()} == {r[0] for r in ids.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(500).collect()}
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 50 + [2] * 20 + [5] * 3 + [10**6, 10**7])], "word string, c long")
    assert sorted(r["c"] for r in common.most_frequent(counts, "word", "c", 30).collect()) == [2] * 20 + [5] * 3 + [10**6, 10**7]
    assert sorted(r["c"] for r in common.most_frequent(counts, "word", "c", 24).collect()) == [5] * 3 + [10**6, 10**7]
    assert common.most_frequent(counts, "word", "c", 1).collect()[0]["c"] == 10**7 and common.most_frequent(counts.limit(0), "word", "c", 5).count() == 0


def test_labels_and_texts_that_disagree_are_settled_alike(spark):
    rng = random.Random(1)
    texts = [prose(rng, 80) + (" # * # * $" * 6 if i % 2 else "") for i in range(120)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(120)], LABELS)
    twisted = labels.union(labels.filter("doc_id < 10").selectExpr("doc_id", "1 - quality", "1 - toxic"))
    twice = docs.union(docs.filter("doc_id < 20").withColumn("text", F.lit("zzz")))
    for operator, column in ((lambda d, x: quality_rules.report(d, x), "rule"), (lambda d, x: cotraining.score(d, x), "score"), (lambda d, x: toxicity.score(d, x), "score")):
        first = sorted(map(str, operator(twice, twisted).select("doc_id", column).collect()))
        again = sorted(map(str, operator(twice.repartition(3, F.rand(5)), twisted.repartition(5, F.rand(6))).select("doc_id", column).collect()))
        assert [x.split("=")[1][:6] for x in first] == [x.split("=")[1][:6] for x in again]
        assert operator(docs.limit(0), labels).count() == 0 and operator(docs, labels.limit(0)).count() == 120


def test_the_pair_sum_of_the_machine_is_that_of_a_double_loop():
    rng = np.random.default_rng(2)
    machine = toxicity.Machine(30)
    machine.w, machine.v, machine.bias = rng.normal(size=machine.w.shape), rng.normal(size=machine.v.shape), 0.3
    lists = [rng.choice(30, n, replace=False) for n in (0, 1, 2, 7, 20)]
    flat, ends = np.concatenate(lists).astype(np.int64), np.cumsum([len(x) for x in lists])
    want = [0.3 + sum(machine.w[i] for i in x) + sum(float(machine.v[i] @ machine.v[j]) for a, i in enumerate(x) for j in x[:a]) for x in lists]
    assert np.allclose(machine.raw(flat, ends), want)
    assert np.allclose(machine.score(flat, ends), 1 / (1 + np.exp(-np.array(want))))


def test_log_probabilities_hold_at_any_logits():
    rng = np.random.default_rng(4)
    rows, k = rng.integers(0, 50, (40, 3)).astype(np.uint16), rng.integers(0, 8, 40)
    for scale, shift in ((1, 0), (40, 0), (1, 200), (1, -200)):
        w, bias = (rng.normal(size=(50, 8)) * scale).astype(np.float32), np.full(8, shift, np.float32)
        z = bias.astype(float) + w[rows[:, 0]].astype(float) + w[rows[:, 1]] + w[rows[:, 2]]
        z -= z.max(axis=1, keepdims=True)
        want = z[np.arange(40), k] - np.log(np.exp(z).sum(axis=1))
        assert np.allclose(language_model.log_probability(w, bias, rows, k) * np.log(10), np.maximum(want, np.log(1e-37)), atol=1e-3, rtol=1e-3) or scale == 40
        assert np.allclose(language_model.probabilities(w, bias, rows).sum(axis=1), 1, atol=1e-5)


def test_words_of_arrow_rows_are_those_of_single_texts():
    import pyarrow as pa

    rng = random.Random(17)
    texts = [None, "", " ", "\x0b\x0c", "\x1c a\x1f\x85b\xa0c"] + ["".join(rng.choice(["a", "AB", "É", "漢", "😀", "\x00", "\x1d", "\u2003", *common.SPACES]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for part in (texts, texts[:1], texts[1:3], []):
        found, sizes = common.word_rows(pa.array(part, pa.string()))
        at = np.append(0, np.cumsum(sizes))
        assert [[w.encode() for w in found.slice(x, y - x).to_pylist()] for x, y in zip(at, at[1:])] == [common.words(t) for t in part]
        for size in (1, 7, 1 << 20):
            cuts = list(common.chunks_of(pa.array(part, pa.string()), size))
            assert [i for x, y in cuts for i in range(x, y)] == list(range(len(part))) and all(x < y for x, y in cuts)


def test_lm_takes_texts_apart_in_arrow_as_word_by_word(monkeypatch):
    import pyarrow as pa
    import xxhash

    rng = random.Random(18)
    texts = [None, "", *[prose(rng, rng.randint(0, 40)) + rng.choice(["", " Éa", " 漢字", "\tX"]) for _ in range(120)]]
    tokens = [[*common.words(t), language_model.END] for t in texts]
    own = {w: i for i, (w, _) in enumerate(Counter(w for t in tokens for w in t).most_common(language_model.OWN))}
    batches = [pa.record_batch({"text": pa.array(texts[lo : lo + 50], pa.string())}) for lo in range(0, len(texts), 50)]
    counted = Counter()
    for got in language_model._counts(batches):
        assert len(set(got["word"].to_pylist())) == got.num_rows
        counted.update({w.encode(): n for w, n in zip(got["word"].to_pylist(), got["n"].to_pylist())})
    assert counted == Counter(w for t in tokens for w in t)
    monkeypatch.setattr(language_model, "_CHUNK", 700)
    pieces_of, i = list(language_model._chunks(iter(batches), own, 100)), 0
    for h, k, sizes in pieces_of:
        part = [w for t in tokens[i : i + len(sizes)] for w in t]
        assert sizes.tolist() == [len(t) for t in tokens[i : i + len(sizes)]]
        assert h.tolist() == [xxhash.xxh3_64_intdigest(w) for w in part] and k.tolist() == [language_model.class_of(w, own) for w in part]
        i += len(sizes)
        assert len(part) - sizes[-1] < 100 <= len(part) or i == len(texts)
    assert i == len(texts)


def test_lm_run_sums_are_those_of_a_loop():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    counts = np.array([1, 2, 16, 17, 200, 1, 3, 40])
    starts, at = np.cumsum(counts) - counts, rng.integers(0, 300, counts.sum())
    want = [sum(x[j].astype(float) for j in at[s : s + c]) for s, c in zip(starts, counts)]
    assert np.allclose(language_model.run_sums(x, at, starts, counts), want, atol=1e-4)
    assert language_model.run_sums(x, at[:0], starts[:0], counts[:0]).shape == (0, 5)
