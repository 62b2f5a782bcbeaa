import random

from dossier.llm import leakage

WORDS = "store ledger folio shows received though gate entry bears witness from deposed that keys of the godown lay with until rain on stopped guarding for days and asked relief citing paragraph under slab unit sales pays fee while one above it more".split()


def _item(rng):
    return [w if rng.random() > 0.35 else f"z{rng.randrange(99_999)}" for w in (rng.choice(WORDS) for _ in range(110))]


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [_item(rng) for _ in range(12)]
    docs, truth = [], set()
    for k in range(160):
        text = [w for _ in range(3) for w in _item(rng)]
        kind, i = k % 8, rng.randrange(12)
        item = list(items[i])
        if kind == 0:
            part = item
        elif kind == 1:
            part = item[30:95]
        elif kind == 2:
            part = [w if rng.random() > 0.03 else "changed" for w in item]
        elif kind == 3:
            part = item[:35] + text[:40] + item[60:95]
        elif kind == 4:
            part = item[:18]
        else:
            part = []
        if part and kind != 4:
            truth.add((k, i))
        body = " ".join(text[:50] + part + text[50:])
        docs.append((k, body.upper() if k % 3 == 0 else body.replace(" ", " ,\t") if k % 3 == 1 else body))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    truth |= {(902, i) for d, i in truth if d == 0}
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(t).capitalize()) for i, t in enumerate(items)] + [(50, None), (51, " ")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(corpus, tests).collect()}
    tokens = lambda s: [w for w in s.lower().replace(",", " ").split() if w]
    brute = {(d, i) for d, t in docs if t for i, item in enumerate(items) if leakage.held(item, tokens(t)) >= leakage.SHARE}
    assert got == brute == truth
    assert leakage.leaks(corpus.limit(0), tests).count() == 0


def test_broken_words_count(spark):
    text = "store ledger folio alpha shows received though gate entry bears witness from bravo deposed that keys charlie of the godown delta lay with until"
    docs = spark.createDataFrame([(1, text.replace("godown", "go-\ndown").replace("received", "recei­\nved"))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text)], "item_id bigint, text string")
    assert leakage.leaks(docs, items).first().share > 0.95


def test_changed_anchor_words(spark):
    """The rarest word of nearly every stretch is changed; held() accepts what is left."""
    rng = random.Random(4)
    items = [[f"z{i}y{k}" if k % 7 == 3 else rng.choice(WORDS) for k in range(110)] for i in range(6)]
    docs = []
    for k in range(30):
        part = [f"changed{k}" if w.startswith("z") else w for w in items[k % 6][7:75]]
        docs.append((k, " ".join([rng.choice(WORDS) for _ in range(60)] + part + [rng.choice(WORDS) for _ in range(40)])))
    assert all(leakage.held(items[k % 6], t.split()) >= leakage.SHARE for k, t in docs)
    docs += [(100 + i, " ".join(t)) for i, t in enumerate(items)]  # the changed words are the rarest of the corpus
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(corpus, tests).collect()}
    assert got == {(k, k % 6) for k in range(30)} | {(100 + i, i) for i in range(6)}


def _held_at_every_offset(item, doc):
    m, covered = len(item), set()
    width = min(leakage.WINDOW, m)
    need = leakage.AGREE if width == leakage.WINDOW else max(1, int(width * leakage.AGREE / leakage.WINDOW))
    for delta in range(-m, len(doc)):
        same = [0 <= i + delta < len(doc) and item[i] == doc[i + delta] for i in range(m)]
        for s in range(m - width + 1):
            if sum(same[s : s + width]) >= need:
                covered |= {i for i in range(s, s + width) if same[i]}
    return len(covered) / m


def test_held_visits_every_offset():
    rng = random.Random(9)
    item = [f"w{k}" for k in range(110)]
    often = item[:20] + ["end"]
    pieces = [w for k in range(22, 108, 16) for w in [*item[k : k + 14], f"part{k}"]]
    assert leakage.held(item, often * 90 + pieces) == _held_at_every_offset(item, often * 90 + pieces) >= leakage.SHARE
    for m in (*range(1, 16), 30, 60):
        item = [rng.choice(WORDS) for _ in range(m)]
        for _ in range(20):
            doc = [rng.choice(WORDS) for _ in range(10)] + [w if rng.random() > 0.12 else "changed" for w in item] + [rng.choice(WORDS) for _ in range(10)]
            assert leakage.held(item, doc) == _held_at_every_offset(item, doc)


def test_short_item(spark):
    corpus = spark.createDataFrame([(1, "one two fee slab paragraph unit sales pays relief asked nine ten"), (2, "nothing of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "fee slab paragraph unit sales pays"), (2, "Relief")], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(corpus, items).collect()} == {(1, 1), (1, 2)}


def test_least_cover():
    """Whatever words are changed, anchors cover at least the part of the held words that needs() gives, over all offsets."""
    rng = random.Random(3)
    for m in (4, 6, 10, 12, 13, 14, 15, 25, 30, 60):
        item = [f"w{k}" for k in range(m)]
        width, need, run, least, cover = leakage.needs(m)
        for _ in range(400):
            share = rng.choice((0.05, 0.12, 0.16))
            doc = [w if rng.random() > share else "changed" for w in item]
            if m == 25 and rng.random() < 0.2:
                doc = [w if k not in (3, 7, 17, 21) else "changed" for k, w in enumerate(item)]
            if leakage.held(item, doc) < leakage.SHARE:
                continue
            at = [i for i in range(m - run + 1) if doc[i : i + run] == item[i : i + run]]
            assert len(at) >= least
            assert len({i + k for i in at for k in range(run)}) >= cover


def test_exactly_half(spark):
    item = [f"w{k}" for k in range(112)]
    docs = [(k, " ".join([f"a{k}"] * 30 + item[at : at + 28] + ["between"] * 9 + item[at + 28 : at + 56] + ["after"])) for k, at in enumerate((0, 20, 56))]
    docs.append((9, " ".join(item[:50])))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.share, r.first_word, r.stretches, r.kind) for r in got} == {(k, 0.5, 30, 2, "proximity") for k in range(3)}


def test_phrase(spark):
    item = [f"w{k}" for k in range(40)]
    docs = [(1, "before it " + " ".join(item) + " after"), (2, " ".join(item[:20] + ["x"] + item[21:]))]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.first_word, r.kind) for r in got} == {(1, 2, "phrase"), (2, 0, "proximity")}


def test_masks_and_sets(spark):
    """Both forms of the aggregate count the same covered words, over the ends of numbers too."""
    rng = random.Random(12)
    rows = [(i, d, run, 2, 5, o, at) for i in range(3) for d in range(20) for run in (1, 2, 3, 4) for o in (-3, 0, 7) for at in rng.sample(range(190), rng.choice((1, 4, 60)))]
    hits = spark.createDataFrame(rows, "item_id bigint, doc_id bigint, run int, least int, cover int, offset int, at int")
    sets, masks = (sorted(map(tuple, f.collect())) for f in (leakage._by_sets(hits), leakage._by_masks(hits, 4)))
    assert len(sets) > 100
    assert sets == masks
    assert all(needed <= 4 for needed in (leakage.needs(m)[2] for m in range(1, 500)))


def test_long_item(spark):
    item = [f"w{k}" for k in range(64 * leakage.MOST_MASKS + 100)]
    docs = spark.createDataFrame([(1, " ".join(item[300:1900])), (2, " ".join(item[:200]))], "doc_id bigint, text string")
    assert [r.doc_id for r in leakage.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()] == [1]
