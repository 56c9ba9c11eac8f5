import pytest

from lathework.llm import lookalike as L

WORDS = ["graded drift battery", "anchored cue task", "TMS load window", "REM map", "serial fatigue field", "rolling reward index", "Bärlin contour", "PSG", "sparse texture", "HRV"] * 20


def model(words=WORDS):
    counts = {}
    for w in words:
        t = L.normalized(w)
        for s, e in L.tokens(t):
            for g in L.grams(t[s:e]):
                counts[g] = counts.get(g, 0) + 1
    return L.Model(counts)


@pytest.mark.parametrize(("given", "plain"), [
    ("graded drіft bаtterу", "graded drift battery"), ("ｄｅｌａｙｅｄ stance ratio ３", "delayed stance ratio 3"), ("serial‑novelty ratio", "serial-novelty ratio"), ("elast‌ic­x", "elasticx"),
    ("conﬂict eﬀect", "conflict effect"), ("В‍ärlin", "Bärlin"), ("déjà-vu", "déjà-vu"), ("α rhythm, θ-γ coupling, β2", "α rhythm, θ-γ coupling, β2"), ("νalence οuter", "valence outer"),
    ("ТМЅ唤醒窗口", "TMS唤醒窗口"), ("ＲＥＭ⻅解⻆度", "REM见解角度"), ("⾦属︀", "金属"), ("金属", "金属"), ("词（狭义，旧译）", "词（狭义，旧译）"), ("x² ½ ① m²", "x² ½ ① m²"), ("", ""), ("plain", "plain"), ("ℌello \U0001d41aB", "Hello aB"),
    ("a　b", "a b"), ("naïve façade rôle señal Ångvik Kōan", "naïve façade rôle señal Ångvik Kōan"), ("Ⅳ", "IV"),
])
def test_plain(given, plain):
    assert L.plain(given, model()) == plain
    assert L.plain(plain, model()) == plain


def test_words_of_other_scripts_stay():
    assert L.plain("привет мир", model()) == "привет мир"
    assert L.plain("λόγος", model()) == "λόγος"
    # a word of look-alikes only is read as its own script where that script is what the corpus holds
    assert L.plain("сор", model(["сор роса сора"] * 50 + WORDS)) == "сор"


def test_letters_of_other_scripts_are_repaired_too():
    for given, plain in (("вoда", "вода"), ("Мoсква", "Москва"), ("вοда", "вода"), ("привeт", "привет"), ("λόγoς", "λόγος")):
        assert L.plain(given, model()) == plain
    # symbols beside Latin letters are no words of either script
    for kept in ("Δt", "μV", "λa", "Δα", "α"):
        assert L.plain(kept, model()) == kept
    assert L.plain("bаtдterу", model()) == "batдtery"


def test_the_scores_choose_between_readings():
    lines = model(["long lattice", "linear field", "Inner index", "Index"] * 30)
    assert L.plain("ӀnnеrӀ", lines)[0] == "I" and L.plain("Іndех", lines) == "Index" and L.plain("fіеӀd", lines) == "field"
    assert L.plain("vаӏuе", model(["value", "valued"] * 30)) == "value"
    assert L.viterbi("сор", L.Model({})) == "cop"  # a tie goes to Latin
    # without the scores the second reading is never taken
    assert L.plain("fіеӀd", L.Model({})) == "fieId"


def test_accents_stay_on_the_letter():
    assert L.plain("cаfё", model()) == "cafë" and L.plain("naїve", model()) == "naïve"


def test_long_text():
    assert L.plain("drіft " * 50_000, model()) == "drift " * 50_000


def test_found(spark, rows):
    data = [(1, "f", "bаtterу"), (1, "f", "bаtterу"), (2, "f", None), (3, "f", ""), (4, "g", "fine")] + [(9, "f", w) for w in WORDS]
    df = spark.createDataFrame(data, "row_id long, field_name string, cell string").withColumnRenamed("x", "plain_text")
    assert rows(L.plain_forms(df)) == [(1, "f", "battery"), (1, "f", "battery")]
    assert rows(L.plain_forms(df.limit(0))) == []
