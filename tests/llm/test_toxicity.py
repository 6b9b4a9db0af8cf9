import random
import re
import zlib

import numpy as np
import pytest

from reposift.llm import toxicity as tox


def corpus(n=3000, seed=1):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "ru", "te", "wo") for b in ("lan", "ner", "sit", "dop", "fam")]
    docs, labels = [], []
    for k in range(n):
        words = rnd.choices(plain, k=rnd.randrange(20, 80))
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Snarkle", "grumb" + rnd.choice(["el", "ett", "os", "ant", "ix", "uu"])]))
        docs.append((k, " ".join(words) + "."))
        if rnd.random() < 0.5:
            labels.append((k, 1, int(toxic != (rnd.random() < 0.02))))
    return docs, labels, {k for (k, t) in docs if "Snarkle" in t or "grumb" in t}


def test_learned_words_and_stems_mark_unseen_documents(spark):
    docs, labels, bad = corpus()
    d = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "Snarkle snarkle you")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.verdicts(d, lab).collect()}
    assert len(got) == len(docs) + 3
    assert all(r.held_out == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k in range(len(docs)) if got[k].held_out]
    right = sum((got[k].predicted == 1) == (k in bad) for k in held) / len(held)
    assert right > 0.98
    assert got[9000].score == got[9001].score < 0.3
    kept = tox.clean(d.where("doc_id IS NOT NULL"), lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if k is not None and not r.predicted}


def test_no_labels_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "You are an idiot"), (2, "kind words")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in tox.verdicts(d, lab).collect()}
    assert got == {1: 1, 2: 0}
    assert tox.verdicts(d.limit(0), lab).count() == 0


def test_merged_patterns_lose(spark):
    """Insults aimed at somebody are labelled toxic, negated and reported ones are not; without the two transducers these are marked as well."""
    rnd = random.Random(6)
    plain = [f"{a}{b}" for a in ("ba", "ko", "mi", "ru", "te", "wo") for b in ("lan", "ner", "sit", "dop", "fam")]
    docs, labels = [], []
    for k in range(3000):
        kind = rnd.choice(["none", "none", "aimed", "negated", "reported"])
        clauses = [" ".join(rnd.choices(plain, k=rnd.randrange(4, 9))) for _ in range(8)]
        for _ in range(2):
            own = {"none": "", "aimed": "you grunk", "negated": "you are not a grunk", "reported": "he said you grunk"}[kind]
            clauses.insert(rnd.randrange(9), f"{own} {rnd.choice(plain)}")
        docs.append((k, ". ".join(clauses)))
        labels.append((k, 1, int(kind == "aimed")))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tox.learn(d, lab)
    assert tox.text_hash("grunk") not in model.words  # as many clean documents hold it
    model = tox.Model({**model.words, tox.text_hash("grunk"): 1.0}, model.stems, model.weights)
    raw = [t.lower().encode() for _, t in docs]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    y = np.array([x[2] for x in labels])
    lost = []
    for machine in (None, tox.composed(1.0, 1.0)):
        x = tox.features(*tox.Grammar(model.words, model.stems, machine).clauses(np.frombuffer(b"".join(raw), np.uint8), offsets))
        lost.append(float(np.mean((x @ tox.fit(x, y) > 0) != (y == 1))))
    assert lost[0] < 0.02 and lost[1] > 0.1


def test_negated_and_reported_clauses_score_below_bare_ones():
    scores = {}
    for text in ("what an idiot", "you idiot", "idiot that you are", "he is not an idiot", "she said idiot", "i will kill you", "we kill time", "never kill you", "they wrote kill you", "you. idiot", "no reason at all to be an idiot"):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, found, words = tox.Grammar({tox.text_hash("idiot"): 1.0}, {}).clauses(raw, np.array([0, len(raw)]))
        scores[text] = found.sum()
    assert scores["he is not an idiot"] < scores["what an idiot"] and scores["she said idiot"] < scores["what an idiot"]
    assert scores["what an idiot"] < scores["you idiot"] == scores["idiot that you are"]
    assert max(scores[x] for x in ("never kill you", "we kill time", "they wrote kill you")) < scores["i will kill you"] / 3
    assert scores["you. idiot"] == scores["what an idiot"] == scores["no reason at all to be an idiot"]


def brute(text, model):
    """Score of a text with plain loops: clause by clause, word by word."""
    text = (text or "").lower()
    total, best, n = [0.0, 0.0], 0.0, len(tox.TOKEN.findall(text))
    for clause in re.split("[.!?;:\n]", text):
        found, aimed, reported, covered, waiting = [0.0, 0.0], False, False, 0, None
        for word in tox.TOKEN.findall(clause):
            raw = word.encode()
            strength = max([model.words.get(tox.text_hash(word), 0.0)] + [model.stems.get(tox._bytes_hash(raw[:k]), 0.0) for k in tox.STEMS if len(raw) >= k])
            kind = "insult" if strength else next((k for k, x in (("report", tox.REPORTS), ("negation", tox.NEGATIONS), ("target", tox.TARGETS), ("threat", tox.THREATS)) if word in x), None)
            scale = (tox.NEGATED if covered else 1) * (tox.REPORTED if reported else 1)
            covered = tox.SCOPE if kind == "negation" else max(covered - 1, 0)
            if kind == "report":
                reported = True
            elif kind in ("insult", "threat"):
                k = int(kind == "threat")
                found[k] += scale * (strength or 1) * (tox.AIMED[k] if aimed else tox.PLAIN[k])
                waiting = waiting if aimed else k
            elif kind == "target":
                if waiting is not None and not aimed:
                    found[waiting] += scale * (tox.AIMED[waiting] - tox.PLAIN[waiting])
                aimed, waiting = True, None
        total = [a + b for a, b in zip(total, found, strict=True)]
        best = max(best, min(sum(found), 1))
    x = [1, best, np.log1p(total[0]), np.log1p(total[1]), np.sqrt(sum(total) / max(n, 1))]
    return 1 / (1 + np.exp(-np.dot(x, model.weights)))


def test_same_as_brute_force(spark):
    rnd = random.Random(11)
    stock = ["Idiot", "idiots", "grumbelix", "snarkle", "you", "du", "not", "nie", "said", "kill", "tuer", "plain", "wörd", "x1", "é"]
    model = tox.Model({tox.text_hash("idiot"): 1.0, tox.text_hash("snarkle"): 0.4}, {tox.text_hash("grumb"): 0.7, tox.text_hash("idio"): 0.2}, (-3.0, 2.0, 1.5, 0.7, 2.0))
    texts = ["".join(rnd.choice(stock) + rnd.choice([" ", " ", " ", ", ", ". ", "! ", "\n", ";"]) for _ in range(rnd.randrange(0, 60))) for _ in range(150)]
    texts += [None, "", ".", "snarkle", "you " * 50 + "idiot", texts[0], "plain " * 300_000 + "you idiot. " + "plain " * 10]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[3], "y")], "doc_id long, text string, score string").repartition(4)
    got = tox.score(df, model)
    assert got.columns == ["doc_id", "text", "score"]
    for r in got.collect():
        assert r.score == pytest.approx(brute(texts[3 if r.doc_id is None else r.doc_id], model), abs=1e-9)


def test_clean_keeps_columns_of_any_name(spark):
    docs, labels, bad = corpus(1200)
    d = spark.createDataFrame([(k, t, k, "a") for k, t in docs] + [(None, None, 1, "b"), (docs[0][0], docs[0][1], 7, "c")], "doc_id long, text string, __score int, __SCORE_ string")
    kept = tox.clean(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == d.columns
    got = {(r.doc_id, r["__score"]) for r in kept.collect()}
    assert (None, 1) in got and all((k, k) in got for k, _ in docs if k not in bad)
