from pyspark.sql import functions as F

from sextant.llm import langid as L

BASE = {
    "pt": ["O relatório não carrega depois da última publicação", "A fila de espera ignora os horários já confirmados", "Vou deixar a tela como estava até amanhã de manhã"],
    "en": ["The report does not load after the latest release", "The waiting list ignores the slots that were confirmed", "I will leave the screen as it was until tomorrow"],
    "es": ["El informe no se carga después de la última publicación", "La lista de espera ignora los horarios ya confirmados", "Voy a dejar la pantalla como estaba hasta mañana"],
    "fr": ["Le rapport ne se charge pas depuis la dernière livraison", "La liste d'attente ignore les horaires déjà confirmés", "Je vais laisser l'écran comme il était jusqu'à demain"],
    "de": ["Der Bericht lädt nicht mehr nach der letzten Auslieferung", "Die Warteliste ignoriert die schon bestätigten Termine", "Ich werde den Bildschirm bis morgen so lassen wie er war"],
    "it": ["Il rapporto non si carica dopo l'ultima pubblicazione", "La lista di attesa ignora gli orari già confermati", "Lascerò lo schermo come era prima fino a domani"],
}
SCHEMA = "doc_id bigint, text string, lang string, para_no int, label string"


def corpus(spark, more=()):
    rows = [(i * 10 + k, ". ".join(BASE[lang][(k + j) % 3] for j in range(2)) + ".", {"pt": "pt_BR", "en": "English"}.get(lang, lang), 5, "x") for i, lang in enumerate(BASE) for k in range(10)]
    return spark.createDataFrame(rows + [(*r, 5, "x") for r in more], SCHEMA)


def test_labels(spark):
    cases = {"pt-BR": "pt", "POR": "pt", "Deutsch": "de", "es-419": "es", "n/a": None, "": None, None: None, "??": None, "gl": "other", "eng": "en", " FR ": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", L.label_language(F.col("l")).alias("x"))
    assert {r.l: r.x for r in df.collect()} == cases


def test_sentences():
    text = "## A heading with many words in it\r\n\r\n- O botão não abre a tela nova.\r\n> Another line with real words here? yes\n \n```\n$a->b(1); code with many words inside\n\nmore code with many words inside\n```\n\t\n2024-01-01T00:00:00Z WARN a/b c d e f code=1\nLGTM"
    assert L.sentences(text) == [(1, b" o botao nao abre a tela nova "), (1, b" another line with real words here ")]
    assert L.sentences("") == [] and L.sentences("ok\n\n👍") == []


def test_segments_and_labels(spark):
    more = [
        (900, BASE["pt"][0] + ".\n\n" + BASE["de"][1] + ". " + BASE["de"][0] + ".", "pt"),
        (901, BASE["en"][1].upper() + ".", None), (902, BASE["fr"][0] + ".", "en"), (903, None, "pt"), (904, "", None), (905, "ok", "xx"), (906, BASE["it"][2] + ". " * 3000, "gl"), (None, BASE["en"][0], "en"), (907, BASE["es"][0] + ".", "es-MX"),
    ]
    docs = corpus(spark, more)
    segs = L.segments(docs, L.fit(docs)).cache()
    got = {(r.doc_id, r.para_no, r.lang) for r in segs.collect() if r.doc_id >= 900}
    assert got == {(900, 0, "pt"), (900, 1, "de"), (901, 0, "en"), (902, 0, "fr"), (906, 0, "it"), (907, 0, "es")}
    why = {r.doc_id: r.problem for r in L.relabel(docs, segs).collect()}
    assert {k: why[k] for k in range(900, 908)} == {900: "mixed", 901: "missing", 902: "wrong", 903: None, 904: None, 905: None, 906: "wrong", 907: None}
    assert all(v is None for k, v in why.items() if k < 900)


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    model = L.fit(docs)
    texts = [s for lang in BASE for s in ([w for _, w in L.sentences(BASE[lang][0] + " " + BASE[lang][2])])]
    assert list(model.probabilities(texts).argmax(axis=1)) == [L.LANGUAGES.index(x) for x in BASE]


def test_nothing_to_learn_from(spark):
    docs = corpus(spark).limit(0)
    assert L.segments(corpus(spark), L.fit(docs)).count() == 0
    assert L.segments(docs, L.fit(docs)).count() == 0
