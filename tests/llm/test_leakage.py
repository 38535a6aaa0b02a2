import random

from pyspark.sql import functions as F

from brindle.llm.leakage import answer_checks, common_subsequence, leaked_items, longest_run, words

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, suite string, lang string, prompt string, answer string"


def invented(rnd):
    return "".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "so", "ni", "va"]) for _ in range(4))


def test_words():
    assert words("So­ft **ｗｉｄｅ** Ze​ro_x") == ["soft", "wide", "zero", "x"]
    assert words(None) == []


def test_runs_and_subsequences():
    import numpy as np

    assert longest_run(np.array([9, 1, 2, 3, 9, 2, 3]), (1, 2, 3, 4)) == 3
    assert common_subsequence(np.array([1, 9, 2, 9, 4]), (1, 2, 3, 4)) == 3


def make(seed=1):
    rnd = random.Random(seed)
    common = ["the", "of", "a", "and", "list", "which", "method", "passes", "without", "cache", "node", "file"]
    prompts = [[rnd.choice(common) if rnd.random() < 0.6 else invented(rnd) for _ in range(40)] for _ in range(30)]
    han = ["".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(60)) for _ in range(5)]
    items = [(n, "s", "en", " ".join(p), "cache 5") for n, p in enumerate(prompts)] + [(100 + n, "s", "zh", p, None) for n, p in enumerate(han)]
    items += [(200, "s", "en", None, None), (201, "s", None, "", None), (None, "s", "en", "x", None), (0, "s", "en", " ".join(prompts[0]), "cache 5")]
    docs = []
    for d in range(300):
        text = [rnd.choice(common) if rnd.random() < 0.9 else invented(rnd) for _ in range(rnd.randint(5, 200))]
        if d % 5 == 0:
            p, size = rnd.choice(prompts), rnd.choice([11, 12, 13, 40])
            start = rnd.randint(0, 40 - size)
            part = p[start : start + size]
            part = [rnd.choice([w, w.upper(), f"**{w}**", w[:1] + "​" + w[1:]]) for w in part]
            at = rnd.randint(0, len(text))
            text[at:at] = part
        joined = rnd.choice([" ", "\n> ", "\t"]).join(text)
        if d % 7 == 0:
            p, size = rnd.choice(han), rnd.choice([19, 20, 60])
            start = rnd.randint(0, 60 - size)
            joined += " 。" + "，".join(p[start : start + size])
        docs.append((d, joined))
    return docs + [(900, None), (901, ""), (902, "the"), (docs[0][0], docs[0][1])], items


def brute(docs, items):
    found = set()
    for d, text in docs:
        own = words(text)
        run, letters = " " + " ".join(own) + " ", "".join(own)
        for i, _, lang, prompt, _ in items:
            if i is None or not prompt:
                continue
            w = words(prompt)
            if lang == "zh":
                s = "".join(w)
                hit = any(s[k : k + 20] in letters for k in range(len(s) - 19))
            else:
                hit = any(f" {' '.join(w[k : k + 12])} " in run for k in range(len(w) - 11))
            if hit:
                found.add((d, i))
    return found


def test_equals_brute_force(spark):
    docs, items = make()
    documents = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("terms", "unspaced", "cosine", "item_id")})
    wanted = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit(1))
    pairs = leaked_items(documents, wanted)
    assert {(r.doc_id, r.item_id) for r in pairs.filter("leaked").collect()} == brute(docs, items)
    checked = answer_checks(pairs.filter("leaked"), spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.answer_found for r in checked if r.item_id >= 100} <= {None}


def test_empty_tables(spark):
    docs, items = make()
    documents, wanted = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leaked_items(documents.limit(0), wanted).count() == 0
    assert leaked_items(documents, wanted.limit(0)).count() == 0


def test_whole_runs_do_not_depend_on_the_cosine(spark):
    docs, items = make(2)
    pairs = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), least=1.01)
    assert {(r.doc_id, r.item_id) for r in pairs.filter("leaked").collect()} == brute(docs, items)


def test_blocks_change_nothing(spark):
    docs, items = make(3)
    documents, wanted = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    rows = [{(r.doc_id, r.item_id, round(r.cosine, 4), r.longest_run, r.leaked) for r in leaked_items(documents, wanted, block_items=n).collect()} for n in (7, 2000)]
    assert rows[0] == rows[1] and rows[0]


def test_paraphrases_are_found(spark):
    """Prompts with every third to fifth word exchanged, so that no run is left whole."""
    docs, items = make(4)
    rnd = random.Random(9)
    prompts = {i: words(p) for i, _, lang, p, _ in items if lang == "en" and p and i is not None}
    want, told = set(), []
    for n in range(80):
        i = rnd.choice(sorted(prompts))
        told_words, at = list(prompts[i]), rnd.randrange(3)
        while at < len(told_words):
            told_words[at] = rnd.choice(prompts[rnd.choice(sorted(prompts))])
            at += rnd.randint(3, 5)
        around = [rnd.choice(prompts[rnd.choice(sorted(prompts))]) for _ in range(40)]
        told.append((1000 + n, " ".join(around[:20] + told_words + around[20:])))
        want.add((1000 + n, i))
    pairs = leaked_items(spark.createDataFrame(docs + told, DOCS), spark.createDataFrame(items, ITEMS)).filter("common_share >= 0.5").collect()
    found = {(r.doc_id, r.item_id) for r in pairs}
    assert len(want & found) >= 0.9 * len(want)
    # Of documents without a prompt none has half of one in common.
    assert not [d for d, _ in found - want if d >= 1000]


def test_sums_are_added_in_a_tree(spark):
    import numpy as np
    import pandas as pd

    from brindle.llm.leakage import _added

    def part(batches):
        held = sum(b["id"].sum() for b in batches)
        yield pd.DataFrame({"slice": [0, 1], "part": [np.array([float(held)]).tobytes(), np.array([1.0]).tobytes()]})

    sums = np.frombuffer(_added(spark.range(0, 1000, 1, 1200).mapInPandas(part, "slice int, part binary")))
    assert sums.tolist() == [499500.0, 1200.0]
