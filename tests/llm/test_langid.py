import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quirespark.llm import langid
from quirespark.llm.common import table

from .conftest import DOCUMENTS


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    out = langid.op5_subword_softmax(spark, sf).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert np.mean([r.rejected for r in out]) < 0.01


def test_prediction_ignores_everything_but_text(spark):
    model = langid.train([("the cat and the hat", "en"), ("der hund und die katze", "de")] * 30)
    rows = [(i, t) for i, t in enumerate(["the hat", "die katze", None, "", "12 !?", "é" * 400_000, "the hat"])]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[i].lang_pred for i in range(5)] == ["en", "de", "und", "und", "und"]
    assert all(out[i].score == 0 and out[i].rejected for i in (2, 3, 4)) and not out[0].rejected
    assert out[5].lang_pred in ("en", "de") and out[0].score == out[6].score


def subwords(text):
    letters = ["_", *(c if c.isalpha() else "_" for c in text.lower()), "_"]
    n = 0
    for k in langid.ORDERS:
        for i in range(len(letters) - k + 1):
            g = letters[i : i + k]
            n += any(c != "_" for c in g) and all(c != "_" for c in g[1:-1]) if k > 1 else g[0] != "_"
    return n


CODE = "for (int i = 0; i < n; i++) { buf[i] = malloc(sizeof(struct node)); if (!buf[i]) return -ENOMEM; }"
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."


@pytest.mark.parametrize("leave", [None, "en", "de", "fr", "es"])
def test_unseen_languages_and_noise_are_rejected(leave):
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2][:800]
    seen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and len(r["text"]) < 20_000 and r["lang"] != leave]
    model = langid.train([(r["text"], r["lang"]) for r in random.Random(1).sample(seen, min(4000, len(seen)))])
    assert langid.TEMPERATURES[0] < model.temperature < langid.TEMPERATURES[-1]
    known = [r for r in held if r["lang"] != leave]
    best, score = model.predict([r["text"] for r in known])
    assert np.mean(score < langid.CERTAIN) < 0.02 and np.mean([model.languages[i] == r["lang"] for i, r in zip(best, known, strict=True)]) > 0.99
    rng = random.Random(2)
    noise = ["".join(rng.choice("qwxzkvjpy bcdfgh 0123") for _ in range(120)) for _ in range(20)]
    assert (model.predict([CODE, POLISH, "すべての人間は、生まれながらにして自由である。", *noise])[1] < langid.CERTAIN).mean() > 0.95
    if leave:
        assert np.mean(model.predict([r["text"] for r in held if r["lang"] == leave])[1] < langid.CERTAIN) >= 0.9


def test_scores_equal_brute_force():
    model = langid.train([("the cat and the hat", "en"), ("der hund und die katze", "de"), ("le chat et la mer", "fr")] * 30)
    texts = ["the hat", "die katze und la mer", "Zzz 12 q", "é" * 50]
    best, score = model.predict(texts)
    for t, k, s in zip(texts, best, score, strict=True):
        rows = np.concatenate([model.rows[b] for b, _ in langid.subwords([t])]).astype(float)
        z = (rows[:, :-1].mean(0) + model.bias) * len(rows) ** model.power / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        far = (rows[:, -1].mean() - model.usual[p.argmax()]) / np.sqrt(model.spread[0] + model.spread[1] / len(rows))
        known = 1 / (1 + np.exp(-model.slope * (far - model.limit)))
        want, language = p.max() * known, p.argmax()
        if want < langid.CERTAIN:
            odds = model.evidence(t)
            q = p * np.exp(odds)
            by_words = q.max() / q.sum() / (1 + np.exp(-odds[q.argmax()]))
            want, language = max((want, language), (by_words, q.argmax()))
        assert k == language and abs(s - want) < 1e-5


def test_evidence_of_words_is_its_definition():
    sample = [("the cat the hat of", "en"), ("of the mat on the mat", "en"), ("die katze und der hut", "de"), ("der hund die maus ö", "de")]
    model = langid.train(sample * 20)
    texts = {"en": ["the cat the hat of", "of the mat on the mat"], "de": ["die katze und der hut", "der hund die maus ö"]}
    share = {k: {w: " ".join(t).split().count(w) / len(" ".join(t).split()) for w in set(" ".join(t).split())} for k, t in texts.items()}
    for text in ("the dog of der hut", "ö the", "xyz", "the cat çé"):
        for k, y in enumerate(("de", "en")):
            other = share["en" if y == "de" else "de"]
            chance = {w: [max(langid.CARRY * f, 0.5 * other.get(w, 0)), langid.CLOSE * f] for w, f in share[y].items()}
            ratios = []
            for i in (0, 1):
                miss = (1 - min(0.99, sum(share[y].values()))) / (1 - min(0.99, sum(c[i] for c in chance.values())))
                ratios.append(sum(np.log(share[y][w] / chance[w][i]) if w in share[y] else np.log(miss) for w in text.split()))
            odd = sum(c not in ("ö" if y == "de" else "") for c in text if not c.isascii())
            assert abs(model.evidence(text)[k] - (min(ratios[0], ratios[1] + langid.GRANTED) + langid.FOREIGN_LETTER * odd)) < 1e-6


KNOWN = {
    "en": ["All human beings are born free and equal in dignity and rights.", "The weather was nice yesterday so we went for a walk in the park.", "Please send the report to the office by Friday morning.", "It is not easy to find a good place to eat in this town.", "The train was late because of the snow on the line.", "She said that it was the best day of the year for all of them."],
    "de": ["Alle Menschen sind frei und gleich an Würde und Rechten geboren.", "Das Wetter war gestern schön und wir sind im Park spazieren gegangen.", "Bitte schicken Sie den Bericht bis Freitag in das Büro.", "Es ist nicht leicht, in dieser Stadt ein gutes Lokal zu finden.", "Der Zug hatte Verspätung, weil auf der Strecke Schnee lag.", "Die Kinder spielten mit dem Hund, und der Vater sah ihnen von der Tür aus zu."],
    "fr": ["Tous les êtres humains naissent libres et égaux en dignité et en droits.", "Il faisait beau hier et nous sommes allés nous promener dans le parc.", "Merci d'envoyer le rapport au bureau avant vendredi matin.", "Ce n'est pas facile de trouver un bon endroit pour manger dans cette ville.", "Le train était en retard à cause de la neige sur la voie.", "Elle a pris le livre sur la table et elle est partie avec les enfants."],
    "es": ["Todos los seres humanos nacen libres e iguales en dignidad y derechos.", "Ayer hizo buen tiempo y fuimos a pasear por el parque.", "Por favor, envíe el informe a la oficina antes del viernes.", "No es fácil encontrar un buen lugar para comer en esta ciudad.", "El tren llegó tarde por culpa de la nieve en la vía.", "La casa de mi abuela está en un pueblo que se ve desde la carretera."],
}
UNKNOWN = [
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.", "Mi ha chiesto se potevo aiutarla con il nuovo computer.", "Per favore mandate la relazione in ufficio entro venerdì mattina.", "Non è facile trovare un buon posto per mangiare in questa città.", "Mio fratello lavora in un ospedale e gli piace il suo lavoro.",
    "Todos os seres humanos nascem livres e iguais em dignidade e em direitos.", "Ela perguntou-me se eu podia ajudá-la com o novo computador.", "Por favor envie o relatório ao escritório até sexta-feira de manhã.", "Não é fácil encontrar um bom lugar para comer nesta cidade.", "O meu irmão trabalha num hospital e gosta do seu trabalho.",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren.", "Ze vroeg me of ik haar met de nieuwe computer kon helpen.", "Stuur het verslag voor vrijdagochtend naar het kantoor.", "Het is niet makkelijk om in deze stad een goede plek te vinden.", "Mijn broer werkt in een ziekenhuis en hij houdt van zijn werk.",
    "Alla människor är födda fria och lika i värde och rättigheter.", "Vädret var fint igår så vi tog en promenad i parken.", "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach.", "Wczoraj była ładna pogoda, więc poszliśmy na spacer do parku.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
]


def test_ordinary_text_of_known_languages_is_kept_and_of_others_rejected():
    """Sentences from outside the corpus, one by one and several together."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    seen = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and len(r["text"]) < 20_000]
    model = langid.train([(r["text"], r["lang"]) for r in random.Random(1).sample(seen, 4000)])
    kept = []
    for language, texts in KNOWN.items():
        best, score = model.predict([*texts, " ".join(texts)])
        right = [model.languages[i] == language for i in best]
        kept += list(right[:-1] & (score[:-1] >= langid.CERTAIN))
        assert right[-1] and score[-1] >= langid.CERTAIN and np.mean(kept[-len(texts) :]) >= 0.6
    assert np.mean(kept) >= 0.9
    assert np.mean(model.predict(UNKNOWN)[1] < langid.CERTAIN) >= 0.9
    assert (model.predict([" ".join(UNKNOWN[i : i + 5]) for i in (0, 5, 10)])[1] < langid.CERTAIN).all()


def test_more_languages_than_dimensions():
    rng = random.Random(3)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for k in range(langid.DIM + 9)}
    model = langid.train([(" ".join(rng.choices(w, k=12)), name) for name, w in words.items() for _ in range(60)])
    tried = [(" ".join(rng.choices(w, k=12)), name) for name, w in words.items() for _ in range(4)]
    best, _ = model.predict([t for t, _ in tried])
    assert model.head is not None and np.mean([model.languages[i] == y for i, (_, y) in zip(best, tried, strict=True)]) > 0.9


def test_repeated_and_missing_ids(spark):
    rows = [(1, "the cat and the hat on the mat", "en"), (1, "...", "en"), (None, "42", "en"), (None, "the hat and the cat", "en")] + [(i, "the cat and the hat and a mat", "en") for i in range(2, 60)]
    kept = langid.drop_rejected(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.doc_id in (1, None)) == [(0, "the hat and the cat"), (1, "the cat and the hat on the mat")]


@pytest.mark.parametrize("text", ["", "a", "ab c", "Straße, İstanbul 42", "  x  ", "é-è"])
def test_subwords(text):
    together = [sum(k[i] for _, k in langid.subwords([text, "zz", text])) for i in range(3)]
    assert together[0] == sum(k[0] for _, k in langid.subwords([text])) and together[1] == subwords("zz")
    assert together[0] == subwords(text)


def test_no_labels_no_rows_and_clashing_columns(spark, small):
    rows = [(i, "some text", None, "s", 0) for i in range(5)]
    out = langid.op5_subword_softmax(spark, small(documents=(rows, DOCUMENTS))).collect()
    assert {r.lang_pred for r in out} == {"und"} and len(out) == 5
    assert langid.op5_subword_softmax(spark, small(documents=([], DOCUMENTS))).count() == 0
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["the", "and", "of"]) for _ in range(20)), "en", 1.0) for i in range(30)] + [(99, "...", "en", 1.0)], "doc_id long, text string, lang string, score double")
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(30))
