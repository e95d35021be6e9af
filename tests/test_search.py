"""Search on a small library in both modes, and the index behind it."""

import pytest

from sharescope.functions.stemming import lexeme
from sharescope.operators import indexing as I
from sharescope.operators import search as Q
from sharescope.operators.permissions import prepare_access, tokens_for
from tests.fixtures import ALICE, BOB, CAROL, EVERYONE, FINANCE, HR, READ, acls_of, files_of, folders_of, frame, shares_of

TEXTS = {1: ("", "readme.txt", "Welcome to the department library"),
         2: ("Finance", "presupuesto 2025.docx", "Presupuesto de la campaña\nde información anual"),
         3: ("Finance", "Informe-ventas.pdf", "Quarterly sales report for the board"),
         4: ("HR", "contratos.txt", "Contratos de trabajo del personal"),
         5: ("Public", "notice.txt", "A public notice nobody else may open")}


@pytest.fixture(scope="module")
def library(spark):
    acls = acls_of(spark, [("all", EVERYONE, "allow", READ, 3), ("fin", FINANCE, "allow", READ, 3), ("hr", ALICE, "deny", READ, 3), ("hr", HR, "allow", READ, 3),
                           ("pub", EVERYONE, "allow", READ, 0), ("pub", FINANCE, "allow", READ, 3)])
    folders = folders_of(spark, [("", "all"), ("Finance", "fin"), ("HR", "hr"), ("Public", "pub")])
    files = files_of(spark, [(i, p, n) for i, (p, n, _) in TEXTS.items()])
    documents = frame(spark, [(i, "text", t) for i, (_, _, t) in TEXTS.items()], "file_id bigint, status string, content string")
    lib = Q.Library(shares_of(spark), folders, files, acls, documents)
    lib.postings = I.postings(files, folders, lib.shares, documents).cache()
    lib.dictionary = I.dictionary(I.vocabulary(lib.postings)).cache()
    TOKENS.update({user: prepare_access(files, folders, acls, token) for user, token in TOKENS.items()})
    return lib


TOKENS = {"alice": tokens_for(ALICE, [FINANCE, HR]), "bob": tokens_for(BOB, [HR]), "carol": tokens_for(CAROL, [])}
BOTH = [("alice", "presupuesto", {2}), ("alice", "contratos", set()), ("bob", "contratos", {4}), ("carol", "", {1}), ("carol", "notice", set()),
        ("alice", "informacion", {2}), ("alice", "CAMPAÑA", {2}), ("alice", "ventas", {3}), ("alice", "quarterly board", {3}), ("alice", "finance", {2, 3}),
        ("alice", "presupuesto -campaña", set()), ("alice", 'presupuesto -"informacion anual"', set()), ("alice", 'presupuesto -"anual informacion"', {2})]


@pytest.mark.parametrize("mode", ["substring", "postings"])
def test_who_finds_what(library, mode):
    for user, q, expected in BOTH:
        got = {r.file_id for r in Q.search(library, TOKENS[user], Q.SearchParams(q), mode).collect()}
        assert got == expected, (mode, user, q)


def test_stems_phrases_and_alternatives(library):
    def ask(user, q):
        return {r.file_id for r in Q.search(library, TOKENS[user], Q.SearchParams(q), "postings").collect()}

    assert ask("bob", "contrato") == {4}          # by its Spanish stem
    assert ask("alice", "reports") == {3}         # by its English stem
    assert ask("alice", '"sales report"') == {3} and ask("alice", '"report sales"') == set()
    assert ask("alice", '"campaña de información"') == {2}   # the stop word keeps its place
    assert ask("alice", "ventas or presupuestos") == {2, 3}
    assert ask("alice", "library -boards") == {1} and ask("alice", "quarterly -boards") == set()
    assert ask("alice", "a") == set()             # a stop word in both languages, and in no name


def test_types_dates_and_order(library):
    def ask(**kw):
        return [r.file_id for r in Q.search(library, TOKENS["alice"], Q.SearchParams(**kw)).collect()]

    assert ask(type="pdf") == [3] and ask(type="word") == [2] and set(ask(type="text")) == {1, 5} and ask(type="other") == []
    assert ask() == [5, 3, 2, 1] and ask(sort="name") == [3, 5, 2, 1]
    assert ask(modified_from="2024-01-03", modified_to="2024-01-04") == [3, 2]
    assert ask(type="nonsense") == [5, 3, 2, 1] and ask(limit=2, offset=1) == [3, 2]
    with pytest.raises(ValueError):
        ask(offset=-1)


def test_names_rank_above_contents(spark, library):
    found = Q.search(library, TOKENS["alice"], Q.SearchParams("finance or board or informe"), "postings").collect()
    assert found[0].file_id == 3 and found[0].score > found[-1].score


def test_many_written_words_fall_back_to_a_join(library):
    rows, sizes = Q._query_lexemes(Q.parse("contrato presupuestos"), True)
    wanted = [(0, *r, sizes[(r[0], r[1], r[2])]) for r in rows]
    few, words = Q.expand_words(library, wanted, True)
    many, none = Q.expand_words(library, wanted, True, cap=0)
    assert words and none is None
    shape = lambda df: sorted((*r[:9], r.word, "".join(sorted(set(r.fields)))) for r in df.collect())
    assert shape(few) == shape(many)


def test_stemmed_matches_brute_force(library):
    """A file matches when, in one reading, every term's lexeme is among all lexemes stored for the file."""
    def stored(i):
        folder, name, text = TEXTS[i]
        out = set()
        for field, value in (("A", name), ("B", f"Docs {folder}"), ("C", text)):
            for w in Q.re.sub(r"[\W_]+", " ", Q.fold_text(value)).split():
                out |= {lexeme(w, c) for c, fields in Q.CONFIG_FIELDS.items() if field in fields}
        return out

    for q in ("contrato", "trabajos personales", "report", "docs", "informes ventas", "libraries", "campana anual", "the library"):
        expected = set()
        for i in (1, 2, 3, 5):
            for c in Q.CONFIG_FIELDS:
                terms = [x for x in (lexeme(t, c) for t in Q.parse(q).terms) if x is not None]
                if terms and set(terms) <= stored(i):
                    expected.add(i)
        got = {r.file_id for r in Q.search(library, TOKENS["alice"], Q.SearchParams(q), "postings").collect()}
        assert got == expected, q


def test_rank_candidates_keep_everything_under_the_cap(library):
    found = Q.matches(library, TOKENS["alice"], Q.SearchParams("finance"), "postings")
    assert Q.rank_candidates(found, 5).count() == found.count() == 2
    assert Q.rank_candidates(found, 1).count() == 1


def test_counts(library):
    found = Q.matches(library, TOKENS["alice"], Q.SearchParams())
    assert Q.capped_count(found).first().asDict() == {"total": 4, "total_capped": False}
    assert Q.capped_count(found, 3).first().asDict() == {"total": 3, "total_capped": True}


def test_snippets_come_with_the_page(library):
    params = Q.SearchParams("campaña")
    page = Q.with_snippets(Q.search(library, TOKENS["alice"], params), library.documents, Q.parse(params.q)).collect()
    assert [s.text for s in page[0].snippet if s.hit] == ["campaña"]


def test_stored_index_gives_the_same_results(spark, library, tmp_path):
    I.write_index(spark, str(tmp_path), library.postings, partitions=2)
    stored = Q.Library(library.shares, library.folders, library.files, library.acls, library.documents,
                       spark.read.parquet(f"{tmp_path}/postings"), spark.read.parquet(f"{tmp_path}/dictionary"))
    for q in ("presupuestos", '"sales report"', "library -boards"):
        ids = lambda lib: [r.file_id for r in Q.search(lib, TOKENS["alice"], Q.SearchParams(q), "postings").collect()]
        assert ids(stored) == ids(library)


def test_many_queries_in_one_job(library):
    asked = {"a": Q.SearchParams("finance"), "b": Q.SearchParams("finance", sort="name"), "c": Q.SearchParams("finance or library", sort="newest", limit=2, offset=1),
             "d": Q.SearchParams("presupuestos -board", type="word"), "e": Q.SearchParams("informe", modified_to="2024-01-03"), "f": Q.SearchParams("reports", share_id=2)}
    rows = sorted(Q.search_many(library, TOKENS["alice"], asked).collect(), key=lambda r: (r["query"], r.position))
    together = {name: [(r.file_id, r.score) for r in rows if r["query"] == name] for name in asked}
    alone = {n: [(r.file_id, r.score) for r in Q.search(library, TOKENS["alice"], p, "postings").collect()] for n, p in asked.items()}
    alone["c"], together["c"] = ([i for i, _ in x["c"]] for x in (alone, together))
    alone["b"], together["b"] = ([i for i, _ in x["b"]] for x in (alone, together))
    assert together == alone


def test_renamed_share(library):
    renamed = library.shares.selectExpr("share_id", "'Legal' AS name", "path", "enabled")
    out = I.rename_share(library.postings, library.files, library.folders, renamed, library.documents, 1)
    words = {(r.field, r.word) for r in out.select("field", "word").distinct().collect()}
    assert ("B", "legal") in words and ("B", "docs") not in words and ("C", "library") in words


def test_relevance_counts_covers_by_weight_and_nearness(spark, library):
    """One file a case: side by side, far apart, repeated, in name and content, as a phrase, and out of order."""
    texts = {1: ("n.txt", "red blue"), 2: ("n.txt", "red one two three blue"), 3: ("n.txt", "red blue x red blue"), 4: ("red.txt", "blue"), 5: ("n.txt", "blue red blue"), 6: ("red blue.txt", "green"),
             7: ("n.txt", "red red blue")}
    files = files_of(spark, [(i, "", n) for i, (n, _) in texts.items()])
    documents = frame(spark, [(i, "text", t) for i, (_, t) in texts.items()], "file_id bigint, status string, content string")
    lib = Q.Library(library.shares, library.folders, files, library.acls, documents)
    lib.postings = I.postings(files, library.folders, lib.shares, documents)
    ask = lambda q: {r.file_id: r.score for r in Q.matches(lib, TOKENS["alice"], Q.SearchParams(q), "postings", False).collect()}
    both = ask("red blue")
    assert both[1] == 0.2 and both[2] == round(0.2 / 4, 6) and both[6] == 1.0 and both[7] == 0.2
    # Covers red..blue, blue..red with x between, red..blue.
    assert both[3] == round(0.2 + 0.2 / 2 + 0.2, 6) and both[5] == 0.4
    # A name and a content with "txt" and "docs" between: the harmonic mean of both weights, over three.
    assert both[4] == round(2 / (1 + 5) / 3, 6)
    assert ask('"red blue"') == {1: 0.2, 3: 0.4, 5: 0.2, 6: 1.0, 7: 0.2}
    assert ask('"red blue" or green')[6] == 1.2 and ask("red or blue")[5] == 0.6
    order = [r.file_id for r in Q.search(lib, TOKENS["alice"], Q.SearchParams("red blue"), "postings", False).collect()]
    assert order == [6, 3, 5, 7, 1, 4, 2]


def plain_snippet(text, terms, width=240):
    """The same rule in plain Python."""
    folded = Q.fold_text(text)
    heads = {t[:-2] if len(t) > 6 else t[:4] for t in terms}
    hits = [m for m in Q.re.finditer(r"\w+", folded) if any(m[0].startswith(h) for h in heads)]
    a = max(0, hits[0].start() - width // 3) if hits else 0
    b = min(len(text), a + width)
    near = [i for i in range(max(0, a - 29), a) if text[i] == " "]
    a = near[-1] + 1 if near else a
    near = [i for i in range(b, min(len(text), b + 30)) if text[i] == " "]
    b = near[0] if near and b < len(text) else b
    out, at = ([("…", False)] if a else []), a
    for m in hits:
        if a <= m.start() and m.end() <= b:
            out += [(text[at:m.start()], False), (text[m.start():m.end()], True)]
            at = m.end()
    out += [(text[at:b], False)] + ([("…", False)] if b < len(text) else [])
    return [(Q.re.sub(r"\s+", " ", t), h) for t, h in out if t]


def test_snippets_mark_hits_in_a_stretch_around_the_first(spark):
    import random
    rng = random.Random(4)
    words = ["informe", "Información", "informal", "campaña", "de", "xinforme", "inform", "a" * 50, "línea\n", "fin_inform"]
    texts = ["", " ", "informe", "xinforme informe", "campañainforme"] + [rng.choice(["", "é" * 70 + " ", " "]) + rng.choice([" ", "  ", "\t"]).join(rng.choices(words, weights=[1, 1, 1, 3, 9, 3, 1, 2, 1, 2], k=rng.randrange(1, 90))) for _ in range(150)]
    texts += ["x" * 300 + "informe" + "y" * 300, "x" * 300 + " informe " + "y" * 300, "informe" * 60]
    rows = frame(spark, list(enumerate(texts)), "i int, t string")
    for terms in (["informes"], ["informacion", "campana"], ["zzz"]):
        got = {r.i: [(s.text, s.hit) for s in r.s] for r in rows.select("i", Q.snippet(Q.F.col("t"), terms).alias("s")).collect()}
        for i, text in enumerate(texts):
            assert got[i] == plain_snippet(text, terms), (terms, text)


def test_response_is_page_snippets_and_count(library):
    rows, total = Q.respond(library, TOKENS["alice"], Q.SearchParams("finance", limit=1), "postings")
    whole = Q.search(library, TOKENS["alice"], Q.SearchParams("finance", limit=1), "postings").collect()
    (got,) = rows.collect()
    assert (got.file_id, got.score) == (whole[0].file_id, whole[0].score) and total.first().asDict() == {"total": 2, "total_capped": False}
    rows, total = Q.respond(library, TOKENS["alice"], Q.SearchParams("", sort="newest"), count=False)
    assert total is None and [r.file_id for r in rows.collect()] == [5, 3, 2, 1] and all(r.snippet == [] for r in rows.collect())
