"""Column functions against fixed expectations and small Python models."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharescope.functions import names as N
from sharescope.functions import paths as P
from sharescope.functions import stemming as M
from sharescope.functions import text as T
from sharescope.functions import values as V
from sharescope.operators import search as Q


def apply(spark, rows, fn, ddl="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {ddl}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def model_fold(s):
    out = []
    for c in s:
        if 0xC0 <= ord(c) < 0x250:
            base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            c = "I" if c == "İ" else base if len(base) == 1 else c
        out.append(c)
    return "".join(out).lower()


def test_fold_and_words(spark):
    assert apply(spark, ["Información CAMPAÑA Über", "İstanbul"], T.fold) == ["informacion campana uber", "istanbul"]
    assert apply(spark, ["INF-2023_Presupuesto.v2.xlsx", "__ ", ""], T.words) == ["inf 2023 presupuesto v2 xlsx", "", ""]


def test_fold_matches_model_on_random_text(spark):
    samples = []

    @settings(max_examples=150, database=None, deadline=None)
    @given(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=20))
    def gather(s):
        samples.append(s)

    gather()
    assert apply(spark, samples, T.fold) == [model_fold(s) for s in samples]
    assert apply(spark, samples, T.words) == [re.sub(r"[\W_]+", " ", model_fold(s)).strip() for s in samples]


def test_clean_content(spark):
    assert apply(spark, ["a\x00b \t\r c\n \n\n\u00a0d \n"], lambda c: T.clean_content(c, 8)) == ["ab c\n\n\u00a0d"]
    assert apply(spark, ["a \t b"], lambda c: T.clean_content(c, 2)) == ["a "]


def test_names(spark):
    names = ["a.b.PDF", ".profile", "x", "x.", "q." + "y" * 40]
    assert apply(spark, names, N.extension) == ["pdf", "", "", "", "y" * 32]
    assert apply(spark, names, N.stem) == ["a.b", ".profile", "x", "x", "q"]
    assert apply(spark, ["Thumbs.db", "THUMBS.DB", "~$x.docx", "a.txt"], N.is_ignored) == [True, True, True, False]
    assert apply(spark, ["docx", "zip", "", "weird"], N.type_group) == ["word", "archive", "other", "other"]


PATTERNS = [
    ("{YYYY}-{MM}-{DD} *", "2025-03-14 Acta consejo.docx", True), ("{YYYY}-{MM}-{DD} *", "2025-13-14 Acta.docx", False),
    ("{YYYY}-{MM}-{DD} *", "Acta 2025-03-14.docx", False), ("Informe {N}", "INFORMÉ 12.pdf", True),
    ("inf-{yy}_??", "INF-25_ab.xlsx", True), ("inf-{yy}_??", "INF-25_abc.xlsx", False), ("*{N}*{N}", "12.pdf", True),
    ("* - {YYYY}", "Obra - 2024 - fase.pdf", False), ("* - {YYYY}", "Obra - fase - 2024.pdf", True),
    ("a(b)+.c", "A(B)+.c.txt", True), ("*", "", True), ("a**b", "axxb.txt", True), ("x?", "x?.txt", True),
    ("{ n }", "77.pdf", True), ("?#", "a#.txt", True), (r"\E*", r"\e1.txt", True),
]


def test_patterns(spark):
    df = spark.createDataFrame([(i, p, n) for i, (p, n, _) in enumerate(PATTERNS)], "i int, p string, n string")
    got = [r[0] for r in df.orderBy("i").select(N.matches_pattern(F.col("n"), N.pattern_regex(F.col("p")))).collect()]
    assert got == [expected for *_, expected in PATTERNS]
    assert apply(spark, ["{DATE} *", "{N} {yyyy}", "{}", "a"], N.pattern_problem) == ["{DATE}", None, "{}", None]


def test_many_stars_stay_linear(spark):
    name = " a" * 120
    df = spark.createDataFrame([("* * * * * * x", name)], "p string, n string")
    assert df.select(N.matches_pattern(F.col("n"), N.pattern_regex(F.col("p")))).first()[0] is False


def test_paths(spark):
    assert apply(spark, ["", "a", "a/b/c"], P.ancestors) == [[""], ["", "a"], ["", "a", "a/b", "a/b/c"]]
    assert apply(spark, ["", "a", "a/b"], P.parent) == [None, "", "a"]
    assert apply(spark, ["", "a/b"], P.depth) == [0, 2]
    raw = ["\\Finance\\\\Budget\\ ", "..", "a:b", "x.", "a?b", "n" * 256, ""]
    assert apply(spark, raw, P.normalize_path)[0] == "Finance/Budget"
    problems = apply(spark, raw, lambda c: P.path_problems(P.normalize_path(c)))
    assert problems == [[], ["dots"], ["character"], ["trailing dot"], ["character"], ["too long"], []]
    order = ["", "Contratos", "Contratos/2024", "Contratos/2024/Obras", "Contratos 2024", "Contratos-B"]
    df = spark.createDataFrame([(p,) for p in reversed(order)], "p string")
    assert [r[0] for r in df.orderBy(P.tree_order(F.col("p"))).collect()] == order


def test_display_path(spark):
    df = spark.createDataFrame([(r"\\fs01\Finance", "Budget/2025", "a.xlsx"), ("/srv/finance/", "Budget/2025", "a.xlsx"),
                                (r"C:\Shares\Finance", "", "")], "s string, f string, n string")
    got = [r[0] for r in df.select(P.display_path(F.col("s"), F.col("f"), F.col("n"))).collect()]
    assert got == [r"\\fs01\Finance\Budget\2025\a.xlsx", "/srv/finance/Budget/2025/a.xlsx", r"C:\Shares\Finance"]


def test_lists_and_accounts(spark):
    assert apply(spark, [[" Pdf", "pdf", "", "x", "X"]], V.clean_list, "array<string>") == [["Pdf", "x"]]
    assert apply(spark, [["..PDF", "pdf", " Docx "]], lambda c: V.clean_list(c, True), "array<string>") == [["pdf", "docx"]]
    typed = ["CORP\\Alice", " alice@Company.com", "alice@other.org", "ALICE"]
    assert apply(spark, typed, lambda c: V.normalize_username(c, "company.com")) == ["alice", "alice", "alice@other.org", "alice"]
    assert apply(spark, ["=1+1", "@x", "-", "ok", "\tx"], V.formula_safe) == ["'=1+1", "'@x", "'-", "ok", "'\tx"]
    assert apply(spark, [0, 10, 2048, 5 * 1024 ** 2, 3 * 1024 ** 3], V.human_size, "bigint") == ["—", "10 B", "2.0 KB", "5.0 MB", "3.0 GB"]
    assert apply(spark, [1, 59, 61, 1800], V.retry_minutes, "bigint") == [1, 1, 2, 30]


QUERIES = [
    ('Presupuesto "plan anual" -borrador INF-2023.pdf or acta', ["presupuesto", "plan", "anual", "inf", "2023", "pdf", "acta"], ["borrador"]),
    ('-"Versión final" acta -copia-2 -', ["acta"], ["version final", "copia 2"]),
    ("", [], []), ("a-b c", ["a", "b", "c"], []), ('-x -y "-z"', ["z"], ["x", "y"]),
]


def test_query_parsing(spark):
    for typed, terms, excluded in QUERIES:
        parsed = Q.parse(typed)
        assert (list(parsed.terms), list(parsed.excluded)) == (terms, excluded), typed
    both = apply(spark, [q for q, *_ in QUERIES], lambda c: F.struct(*[v.alias(k) for k, v in Q.parse_column(c).items()]))
    assert [(list(r.terms), list(r.excluded)) for r in both] == [(t, x) for _, t, x in QUERIES]
    assert Q.parse('a "b c" or d').clauses == ((("a",), ("b", "c")), (("d",),))


@pytest.mark.parametrize("word,stem", [("contratos", "contrat"), ("contrato", "contrat"), ("presupuestos", "presupuest"),
                                       ("rapidamente", "rapid"), ("actividades", "activ"), ("nacionales", "nacional")])
def test_spanish_stems(word, stem):
    assert M.spanish_stem(word) == stem


@pytest.mark.parametrize("word,stem", [("reports", "report"), ("reporting", "report"), ("relational", "relat"), ("hopping", "hop"),
                                       ("hoping", "hope"), ("flies", "fli"), ("agreed", "agre"), ("generously", "generous"),
                                       ("happiness", "happi"), ("controlling", "control"), ("skies", "sky")])
def test_english_stems(word, stem):
    assert M.english_stem(word) == stem


def test_lexemes():
    assert M.lexeme("de", "spanish") is None and M.lexeme("de", "english") == "de"
    assert M.lexeme("2023a", "spanish") == "2023a" and M.lexeme("the", "english") is None


def test_snippets():
    text = "uno dos tres " * 40 + "el presupuesto anual de la obra " + "cuatro cinco " * 40
    segments = Q.snippet_segments(text, ["presupuesto"], width=60)
    assert segments[0] == {"text": "…", "hit": False} and segments[-1] == {"text": "…", "hit": False}
    assert [s["text"] for s in segments if s["hit"]] == ["presupuesto"]
    assert Q.snippet_segments("Informe de ventas", ["ventas"]) == [{"text": "Informe de ", "hit": False}, {"text": "ventas", "hit": True}]
    assert Q.snippet_segments("", ["x"]) == [] and Q.snippet_segments("abc", []) == [{"text": "abc", "hit": False}]
