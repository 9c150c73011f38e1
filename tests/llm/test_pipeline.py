import random

import sentencepiece

import corpus_pipeline
from quirespark.llm import pieces

from .conftest import DOCUMENTS
from .test_decontaminate import plain as contamination
from .test_simhash import plain_components, plain_fingerprint


def fixture():
    rng = random.Random(8)
    en, de = "the of and to in that river house stone with for".split(), "der die und nicht einen schloss fluss haus mit für".split()
    bench = [(i, " ".join(rng.choice(en) + str(rng.randint(0, 99)) for _ in range(25))) for i in range(5)]
    docs = []
    for i in range(300):
        words = [rng.choice(en if i % 2 else de) + rng.choice(["", "s", "t"]) for _ in range(rng.randint(40, 80))]
        if i % 10 in (3, 4):
            words.insert(5, "scoundrel")
        if i % 25 == 7:
            words += bench[i % 5][1].split()
        docs.append((i, " ".join(words), "en" if i % 2 else "de"))
    docs += [(400 + i, docs[i][1].upper() if i % 2 else docs[i][1], "en") for i in range(0, 60, 4)]
    docs += [(500, "*** 123 ***", "en"), (501, None, "en"), (502, "", None)]
    return docs, bench


def test_stages_against_brute_force(spark, small):
    docs, bench = fixture()
    kind = DOCUMENTS + ", score double, rank int"
    labels = [(i, 1, int("scoundrel" in (t or ""))) for i, t, _ in docs if i < 250]
    where = small(documents=([(i, t, lang, "src", len(t or ""), 0.5, 1) for i, t, lang in docs], kind), benchmark=(bench, "item_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))
    columns = spark.read.parquet(f"{where}/documents.parquet").columns
    texts = {i: t for i, t, _ in docs}
    left = dict(texts)

    for i in (500, 501, 502):
        del left[i]
    after = [dict(left)]
    left = {i: t for i, t in left.items() if "scoundrel" not in t.lower()}
    after.append(dict(left))
    fps = {i: plain_fingerprint(t) for i, t in left.items()}
    comp, least = plain_components(set(fps.values())), {}
    for i, f in fps.items():
        least[comp[f]] = min(i, least.get(comp[f], i))
    left = {i: left[i] for i in least.values()}
    after.append(dict(left))
    bad = {i for i, *_, c in contamination(list(left.items()), bench) if c}
    assert bad
    grams = {tuple(w[k : k + 13]) for _, t in bench for w in [t.split()] for k in range(len(w) - 12)}
    for i in bad:  # the words of benchmark windows go, the document stays
        w = left[i].lower().split()
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(13)}
        left[i] = [x for k, x in enumerate(left[i].split()) if k not in hit]
    left = {i: t if isinstance(t, str) else " ".join(t) for i, t in left.items() if t}
    after.append(dict(left))

    df = spark.read.parquet(f"{where}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], after, strict=True):
        stage(spark, df, where).write.parquet(f"{where}/{name}")
        df = spark.read.parquet(f"{where}/{name}")
        assert df.columns == columns, name
        rows = df.collect()
        assert {r.doc_id: " ".join((r.text or "").split()) for r in rows} == {i: " ".join((t or "").split()) for i, t in want.items()}, name
        assert all(r.n_chars == len(r.text) for r in rows)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id: r.ids for r in out} == {r.doc_id: lib.encode(r.text) for r in rows} and set(left) == {r.doc_id for r in out}
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_empty(spark, small):
    where = small(documents=([], DOCUMENTS), benchmark=([], "item_id long, text string"), labels=([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, where).count() == 0
