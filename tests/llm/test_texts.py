"""Language, quality and near copies."""

import re

import numpy as np
from pyspark.sql import functions as F

from hirelake.llm import jaccard, langid, quality
from hirelake.llm.common import remainder

TEN = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    documents = spark.read.parquet(f"{TEN}/documents.parquet")
    held_out = remainder("doc_id", 4) == 2
    model = langid.fit(documents, ~held_out)
    assert model.langs == ["de", "en", "es", "fr"]
    told = langid.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    right = told.filter(held_out).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_of_odd_rows(spark, odd_documents):
    frame = odd_documents()
    model = langid.fit(frame, F.lit(True))
    told = langid.predict(frame, model).collect()
    assert len(told) == frame.count()
    by_key = {r.doc_id: (r.lang_pred, r.score) for r in told}
    assert by_key[1] == ("en", 1.0) == by_key[5]
    assert by_key[2] == by_key[3] == by_key[4] == ("und", 0.0)
    nothing = langid.fit(frame.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.predict(frame, nothing).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).count() == 0


def test_backoff():
    rows = [(0, "known", "a", 4)] + [
        (n, g, "b", 1) for n in (1, 2, 3) for g in langid.grams("wort", n)
    ]
    model = langid.Model(["a", "b"], rows, {("a", 0): 4, **{("b", n): 5 for n in (1, 2, 3)}})
    assert model.score_word("known").argmax() == 0
    # "wortig" has no known n-gram of five or four letters, but some of three.
    hits = [model.known[3][g] for g in langid.grams("wortig", 3) if g in model.known[3]]
    assert np.allclose(model.score_word("wortig"), np.mean(hits, axis=0))
    assert not model.score_word("漢").any() or model.known[1].get("^") is not None


def test_quality_held_out(spark):
    documents = spark.read.parquet(f"{TEN}/documents.parquet")
    labels = spark.read.parquet(f"{TEN}/labels.parquet")
    held_out = remainder("doc_id", 5) == 0
    model = quality.fit(documents, labels, ~held_out)
    told = quality.score(documents, model).join(labels, "doc_id").filter(held_out)
    right = told.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93


def test_votes_by_brute_force():
    rng = np.random.default_rng(4)
    rows = np.log1p(rng.poisson(0.05, (300, quality.FEATURES))).astype(np.float32)
    labels = rng.integers(0, 2, 300).astype(float)
    model = quality.fit_model(rows, labels, np.ones(300))
    found = model.score(rows[:40])
    for row, score in zip(model.latent(rows[:40]), found):
        cosine = np.maximum(model.vectors @ row, 0)
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = cosine[near] ** quality.SHARPNESS
        assert abs(score - (vote * labels[near]).sum() / vote.sum()) < 1e-4


def test_quality_of_odd_rows(spark, odd_documents):
    frame = odd_documents()
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(frame, labels, F.lit(True))
    by_key = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert by_key[2] == by_key[3] == by_key[4] == 0.5
    assert by_key[1] > 0.9 > 0.1 > by_key[5]
    nothing = quality.fit(frame, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(frame, nothing).collect()} == {0.5}
    assert quality.score(frame.limit(0), model).count() == 0


def _sets(rows):
    out = {}
    for key, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        grams = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {text} - {None, ""}
        out[key] = grams
    return out


def _groups(sets, threshold=0.8):
    keys = sorted(sets)
    links = {k: set() for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    group = {}
    for k in keys:
        if k not in group:
            todo = [k]
            group[k] = k
            while todo:
                for other in links[todo.pop()] - group.keys():
                    group[other] = k
                    todo.append(other)
    same = {k: min(o for o in keys if sets[o] == sets[k]) if sets[k] else k for k in keys}
    return {k: (same[k], len(links[k]), group[k]) for k in keys}


def _found(frame):
    return {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.near_copies(frame).collect()}


def test_near_copies_by_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert _found(documents) == _groups(_sets(rows))


def test_near_copies_of_odd_rows(spark, odd_documents, monkeypatch):
    base = [f"w{n}" for n in range(60)]
    # A chain: neighbours are alike, its ends are not; and a large group of near copies.
    chain = [(100 + n, " ".join(base[n : n + 50])) for n in range(8)]
    group = [(200 + n, " ".join(["g%d" % i for i in range(80)] + [f"end{n}"])) for n in range(40)]
    short = [(300, "hello"), (301, "Hello!"), (302, "!!!"), (303, "!!!"), (304, "???")]
    frame = odd_documents(*chain, *group, *short)
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # so that the groups need many pairs of blocks
    rows = {r.doc_id: r.text for r in frame.collect() if r.doc_id is not None}
    assert _found(frame) == _groups(_sets(rows.items()))
    assert jaccard.near_copies(frame.limit(0)).count() == 0


def test_bands():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = jaccard.bands_and_rows(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= jaccard.HASHES


def test_language_model_and_scores_by_brute_force(spark, documents):
    """Counts, logarithms, backoff and odds from the definition, for every text."""
    rows = documents.select("doc_id", "text", "lang").collect()
    model = langid.fit(documents, F.lit(True))
    counts = {}
    for r in rows:
        for word in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            marked = f"^{word}$"
            entries = [(0, word)] + [
                (n, marked[i : i + n]) for n in range(1, langid.LONGEST + 1) for i in range(len(marked) - n + 1)
            ]
            for entry in entries:
                counts.setdefault(entry, dict.fromkeys(model.langs, 0))[r.lang] += 1
    often = {e: c for e, c in counts.items() if sum(c.values()) >= langid.LEAST}
    size = [sum(e[0] == k for e in often) for k in range(langid.LONGEST + 1)]
    total = [{lang: sum(c[lang] for e, c in counts.items() if e[0] == k) for lang in model.langs} for k in range(langid.LONGEST + 1)]
    assert [set(known) for known in model.known] == [
        {e for k, e in often if k == kind} for kind in range(langid.LONGEST + 1)
    ]

    def logs(kind, entry):
        bottom = [total[kind][lang] + langid.SMOOTHING * (size[kind] + 1) for lang in model.langs]
        return np.log([(often[kind, entry][lang] + langid.SMOOTHING) / b for lang, b in zip(model.langs, bottom)])

    def score(word):
        if (0, word) in often:
            return logs(0, word)
        for n in range(langid.LONGEST, 0, -1):
            marked = f"^{word}$"
            hits = [logs(n, g) for i in range(len(marked) - n + 1) if (n, g := marked[i : i + n]) in often]
            if hits:
                return np.mean(hits, axis=0)
        return np.zeros(len(model.langs))

    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents, model).collect()}
    for r in rows[::5]:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not words:
            assert told[r.doc_id] == ("und", 0.0)
            continue
        mean = np.mean([score(w) for w in words], axis=0)
        odds = np.exp((mean - mean.max()) * min(len(words), langid.CERTAIN_WORDS))
        assert told[r.doc_id][0] == model.langs[int(odds.argmax())]
        assert abs(told[r.doc_id][1] - odds.max() / odds.sum()) < 1e-3
