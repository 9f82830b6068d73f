import time

import numpy as np
import pytest

from cairn.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.training_sample(spark.read.parquet(f"{SF}/documents.parquet")), per_language=800)


def test_labels():
    want = {"en-GB": "en", "EN_us": "en", "English": "en", " deu ": "de", "ger": "de", "dut": "nl", "pt-BR": "pt", "JPN": "ja", "xx": None, "und": None, "n/a": None, "?": None, "": None, None: None, "unknown": None}
    assert {k: L.label_code(k) for k in want} == want


def test_only_prose_counts():
    text = "## loadIt\n\n```ts\nconst this is code\n```\nfix(net): The list is read twice (\"Datei nicht gefunden\") in src/a/b.ts! Why `so much` here?\n11:02:03.1 INFO started the run now\n"
    got = [" ".join(w) for _, _, w in L.sentences(text)]
    assert got == ["the list is read twice in"]
    assert L.sentences("") == [] and L.sentences("==== ---- ====\n123 456 0x1F") == []


def test_folding():
    assert L.fold("GRÖSSE") == L.fold("grosse") == L.fold("größe") and L.fold("cafÃ©") == L.fold("café") == "cafe" and L.fold("a​b") == "ab"


def test_codewords_are_far_apart():
    code = L.codewords(11)
    d = (L.BITS - code @ code.T) / 2
    assert d[~np.eye(11, dtype=bool)].min() >= 9 and not (np.abs(code.sum(0)) == 11).any()
    assert L.codewords(2).shape == (2, L.BITS) and (L.codewords(2).sum(0) == 0).all() and L.codewords(1).shape == (1, L.BITS)


def test_few_languages():
    one = L.train([("the list is read twice here", "en")] * 20)
    assert one.langs == ["en"] and [x[3] for x in L.document_segments("nobody knows why it is so", one)] == ["en"]
    assert L.train([("the list is read twice here", "en")] * 3) is None and L.train([]) is None


def test_a_few_wrong_bits_do_no_harm(model):
    code = model.code
    m = code[2].astype(float) * 4
    m[[1, 7, 20]] *= -1
    assert model.losses(m[None]).argmin() == 2


SAMPLES = {
    "en": "The reviewer asked us to rename the file and nobody expected that. Please check whether it still works.",
    "de": "Soweit wir sehen behält das Verzeichnis eine veraltete Kopie. Leider gibt es keinen Grund dafür.",
    "fr": "Il faut vérifier si le classement utilise encore la mémoire cache. Personne ne s'y attendait.",
    "es": "No hay ninguna razón para leer el archivo dos veces. Deberíamos anotarlo.",
    "nl": "Op de bouwmachine bewaart het bestand een oude kopie. Dat moeten we opschrijven.",
    "ru": "Нужно проверить, использует ли журнал ещё временный кэш. Это стоит записать.",
    "ja": "前回の更新のあと、作業記録が古い写しを持っているようです。夜間の更新を作り直していることが分かりました。",
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_written_or_damaged(model, lang):
    for text in (SAMPLES[lang], SAMPLES[lang].upper(), L.fold(SAMPLES[lang])):
        assert [x[0] for x in L.document_languages(L.document_segments(text, model))] == [lang]


def test_stretches(model):
    both = SAMPLES["en"] + "\n" + SAMPLES["ru"]
    s = L.document_segments(both, model)
    assert [x[3] for x in s] == ["en", "ru"] and all(0 < x[4] <= 1 for x in s) and both[s[1][0] : s[1][1]].strip() == SAMPLES["ru"]
    single = SAMPLES["en"] + " " + SAMPLES["fr"].split(". ")[0] + "."
    assert [x[0] for x in L.document_languages(L.document_segments(single, model))] == ["en"]


def test_held_out_accuracy(spark):
    """Agreement with the labels of documents that were not trained on; a tenth of the labels is wrong."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = L.train(L.training_sample(d.where("doc_id % 2 = 0"), 200), per_language=800)
    rows = d.where("doc_id % 2 = 1 and n_chars between 100 and 5000").select("text", "lang").limit(1500).collect()
    same = known = 0
    for r in rows:
        code = L.label_code(r.lang)
        got = [x[0] for x in L.document_languages(L.document_segments(r.text, m))]
        if code and got:
            known += 1
            same += code in got
    assert known > 800 and same / known > 0.85


def test_tables(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, " \n", None), (-4, SAMPLES["de"], "en"), (-5, SAMPLES["de"], "de_AT"), (-5, SAMPLES["de"], "de_AT"), (None, SAMPLES["fr"], None), (-6, SAMPLES["en"] * 800, None)], "doc_id bigint, text string, lang string")
    got = [(r.doc_id, r.lang) for r in L.label_findings(d.unionByName(extra)).where("doc_id is null or doc_id < 0").collect()]
    assert sorted(got, key=str) == sorted([(-4, "de"), (None, "fr"), (-6, "en")], key=str)
    assert L.label_findings(d.limit(0)).isEmpty() and L.language_segments(extra).isEmpty()


def test_a_neighbour_decides_only_among_likely_languages():
    class Model:
        langs = ["da", "en", "sv"]

        def predict(self, bags):
            p = np.array([{"english": [0, 1, 0], "danish": [1, 0, 0], "either": [0.5, 0.02, 0.48], "unsure": [0.36, 0.3, 0.34]}[w[0]] for w in bags])
            return p.argmax(1), p.max(1), p

    def langs(*kinds):
        text = " ".join(f"{k.capitalize()} words make up this whole sentence here." for k in kinds)
        assert len(L.sentences(text)) == len(kinds)
        return [(x[3], x[2]) for x in L.document_segments(text, Model())]

    assert langs("english", "english", "either", "either") == [("en", 2), ("da", 2)]
    assert langs("english", "either", "danish") == [("en", 1), ("da", 2)]
    assert langs("english", "unsure", "english") == [("en", 3)]


def test_labels_of_all_languages():
    assert len({c for c in L.NAMES.values()}) >= 180
    want = {"ga": "ga", "gle": "ga", "Irish": "ga", "af-ZA": "af", "MSA": "ms", "cym": "cy", "wel": "cy", "Scottish Gaelic": "gd", "pt_BR.UTF-8": "pt", "english (us)": "en", "cmn": "zh", "tgl": "tl", "Swahili": "sw", "\tfr\n": "fr", "qaa": None, "english text": None}
    assert {k: L.label_code(k) for k in want} == want


def test_quotations_and_words_of_any_length():
    for a, b in ('""', "``", "<>", "\u201c\u201d", "\u201e\u201c", "\u00ab\u00bb", "\u300c\u300d"):
        text = "The list is read twice " + a + "und niemand weiss warum " * 100 + b + " in this house."
        assert [w for _, _, w in L.sentences(text)] == [["the", "list", "is", "read", "twice", "in", "this", "house"]], a
    assert [len(w) for _, _, w in L.sentences('A mark of 5" opens nothing here.\nAnd neither < does that today.')] == [6, 5]
    long = "donaudampfschifffahrtsgesellschaftskapitaenskajuetenschluessel"
    assert long in L.sentences(f"Der {long} ist leider nicht mehr da.")[0][2]
    assert L.sentences("iciaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "a" * 500 + " encore une fois.")[0][2][0] == "icia"
    assert L.sentences("x" * 2_000_000) == []


@pytest.mark.parametrize("text", ['"' * 300_000, "<a " * 200_000, "`" * 300_000, "```" * 100_000, "~~~\n" * 100_000, "at " * 200_000, "a(" * 200_000, "." * 300_000, "!?" * 200_000, "[1" * 200_000, "a\u00c3" * 200_000, "\u201e" * 300_000])
def test_linear_time(text):
    began = time.perf_counter()
    L.sentences(text)
    assert time.perf_counter() - began < 8


def test_batches_equal_single_texts(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(400).collect()
    texts = [r.text for r in rows] + [None, "", " ", SAMPLES["en"] * 300, "日本語" * 2000]
    short = lambda found: [(*x[:4], round(x[4], 3), x[5]) for x in found]
    want = [short(L.document_segments(t, model)) for t in texts]
    assert [short(x) for x in L.batch_segments(texts, model)] == want
    step, memo = L.STEP, L.MEMO
    try:
        L.STEP, L.MEMO = 7, 20
        assert [short(x) for x in L.batch_segments(texts, model)] == want
    finally:
        L.STEP, L.MEMO = step, memo


def test_planted_stretches(spark):
    """Stretches of two or three sentences of held-out texts, set after one another: languages, ends and confidence."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = L.train(L.training_sample(d.where("doc_id % 2 = 0"), 300))
    random, by = np.random.default_rng(1), {}
    for r in d.where("doc_id % 2 = 1 and n_chars between 80 and 3000").select("text", "lang").orderBy("doc_id").limit(3000).collect():
        code, found = L.label_code(r.lang), L.document_segments(r.text, m)
        if code and len(found) == 1 and found[0][3] == code and found[0][2] >= 3:  # what label and text agree on
            by.setdefault(code, []).append([r.text[a:b].strip() for a, b, _ in L.sentences(r.text)])
    langs = sorted(x for x, v in by.items() if len(v) >= 20)
    assert len(langs) >= 6
    right = total = 0
    sure, good = [], []
    for _ in range(400):
        a, b = random.choice(langs, 2, replace=False)
        one, two = (by[x][random.integers(len(by[x]))][: 2 + random.integers(2)] for x in (a, b))
        text = " ".join(one) + "\n" + " ".join(two)
        cut, found = len(" ".join(one)), L.document_segments(text, m)
        for lo, hi, want in ((0, cut, a), (cut, len(text), b)):
            inside = [x for x in found if x[3] == want and min(x[1], hi) - max(x[0], lo) > 0.8 * (hi - lo)]
            total, right = total + 1, right + bool(inside)
        for x in found:
            sure.append(x[4])
            good.append(x[3] == (a if (x[0] + x[1]) / 2 < cut else b))
    sure, good = np.array(sure), np.array(good)
    print("stretches found", right / total, "right", good.mean(), "mean confidence", sure.mean())
    assert right / total > 0.95 and good.mean() > 0.95 and abs(sure.mean() - good.mean()) < 0.05


def test_repeated_texts_count_under_their_usual_label(spark):
    rows = [("The list is read twice here.", "en")] * 5 + [("The list is read twice here.", "nl")] * 2 + [("Dat moeten we opschrijven.", "nl"), ("Nobody knows yet why.", "en"), ("Nobody knows yet why.", "nl")]
    d = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(set(L.training_sample(d))) == [("Dat moeten we opschrijven.", "nl"), ("The list is read twice here.", "en")]
    assert L.training_sample(d.limit(0)) == []
