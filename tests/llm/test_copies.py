import itertools
import random

import numpy as np
import pytest

from dossier.llm import nearcopies

VOCABULARY = [f"w{k}x" for k in range(4000)]
FORM = [f"form{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]


def _page(rng):
    return FORM[:25] + [rng.choice(VOCABULARY) for _ in range(90)]


def _edited(rng, words, share=0.04):
    words = [w if rng.random() > share else rng.choice(["misrd", "noise"]) + str(rng.randrange(9999)) for w in words]
    cut = rng.randrange(len(words))
    return words[cut:] + words[:cut]


def _dice(a, b):
    x, y = nearcopies.words(a), nearcopies.words(b)
    return 2 * len(x & y) / (len(x) + len(y))


def test_against_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for k in range(150):
        page = _page(rng)
        texts.append(page)
        for _ in range(rng.choice([0, 0, 1, 3, 9]) if k else 160):
            texts.append(_edited(rng, page))
    common = FORM + [f"plain{k}" for k in range(20)]
    texts += [common, _edited(rng, common, 0.02), list(common)]
    pages = [(i, "\n".join(" ".join(t[j : j + 9]) for j in range(0, len(t), 9))) for i, t in enumerate(texts)]
    rows = [*pages, (9000, None), (9001, ""), (9002, "too short"), (9003, "long " * 50_000), (None, "x " * 80), pages[5]]
    got = {tuple(r) for r in nearcopies.copy_pairs(nearcopies.classes(spark.createDataFrame(rows, "page_id bigint, text string"))).collect()}
    linked = [(i, j) for (i, a), (j, b) in itertools.combinations(pages, 2) if _dice(a, b) >= nearcopies.SIMILAR]
    parent = list(range(len(pages)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {(i, j) for i, j in itertools.combinations(range(len(pages)), 2) if find(i) == find(j)}
    assert got == want


def test_empty(spark):
    assert nearcopies.classes(spark.createDataFrame([], "page_id bigint, text string")).count() == 0


@pytest.mark.parametrize("share", [0.05, 0.08])
def test_crowd_of_noisy_copies(spark, share):
    """A group copied so often that its own words are frequent, each copy with rare words of its own noise only."""
    rng = random.Random(7)
    base = FORM + rng.sample(VOCABULARY, 140)
    pages = [rng.sample(FORM, 50) + rng.sample(VOCABULARY, 120) for _ in range(500)]
    crowd = [[w if rng.random() > share else f"noise{rng.randrange(10**9)}" for w in base] for _ in range(240)]
    rows = [(i, " ".join(t)) for i, t in enumerate(pages[:250] + crowd + pages[250:])]
    ids = range(250, 490)
    classed = {r.page_id: r.class_id for r in nearcopies.classes(spark.createDataFrame(rows, "page_id bigint, text string")).collect()}
    assert set(classed) <= set(ids)
    linked = [(i, j) for i, j in itertools.combinations(ids, 2) if _dice(rows[i][1], rows[j][1]) >= nearcopies.SIMILAR]
    assert {i for pair in linked for i in pair} == set(ids)
    assert {classed.get(i) for i in ids} == {250}


@pytest.mark.parametrize("word", ["plain{}x", "{}"])
def test_one_page_of_many_copies(spark, word):
    """160 copies among 600 pages, each with 6 % of its words edited; with digits in the words and without. Every close pair is found."""
    rng = random.Random(5)
    letters = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(4))
    vocabulary = [word.format(k if "x" in word else letters(k)) for k in range(4000)]
    form = vocabulary[:60]
    pages = [rng.sample(form, 30) + rng.sample(vocabulary, 110) for _ in range(440)]
    pages += [[w if rng.random() > 0.06 else rng.choice(vocabulary) for w in pages[0]] for _ in range(160)]
    rows = [(i, " ".join(t)) for i, t in enumerate(pages)]
    got = {tuple(r) for r in nearcopies.copy_pairs(nearcopies.classes(spark.createDataFrame(rows, "page_id bigint, text string"))).collect()}
    close = {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if _dice(a, b) >= nearcopies.SIMILAR}
    assert len(close) > 12_000
    assert close <= got


def test_matrix_closes_no_reaching_block():
    """The bound of a block's union is never below the overlap with a member, also where words share bits."""
    rng = random.Random(3)
    for n in (70, 400, 3000):
        a = {f"w{rng.randrange(2 * n)}" for _ in range(n)}
        members = [{f"w{rng.randrange(2 * n)}" for _ in range(n)} for _ in range(5)]
        row = nearcopies.bits_of(nearcopies.hashed(a))
        union = np.bitwise_or.reduce([nearcopies.bits_of(nearcopies.hashed(m)) for m in members])
        bound = int(np.bitwise_count(row & union).sum()) + len(a) - int(np.bitwise_count(row).sum())
        assert bound >= max(len(a & m) for m in members)


def test_files_of_a_class(spark):
    page = " ".join(f"w{k}" for k in range(90))
    frame = spark.createDataFrame([(1, page, "Annexure-2.pdf"), (2, page, "annexure_3.PDF"), (3, page, "scan.pdf"), (4, page, None), (5, "w1", "x")], "page_id bigint, text string, source_file string")
    got = {r.page_id: (r.class_id, r.same_file) for r in nearcopies.with_files(nearcopies.classes(frame), frame).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, False), 4: (1, False)}
