import pytest

from codeweft.llm import personal as ps
from conftest import rows

DOC = "doc_id bigint, text string, kind string, start bigint"


def kinds(text):
    return sorted((k, text[s:e]) for s, e, k, _ in ps.shaped(text))


@pytest.mark.parametrize(("text", "want"), [
    ("Write to ada.byron+x@mail.example.org, please.", [("email", "ada.byron+x@mail.example.org")]),
    ("<a_b [at] example [dot] com> or c.d(at)post(dot)invalid; e AT dev DOT corp DOT test", [("email", "a_b [at] example [dot] com"), ("email", "c.d(at)post(dot)invalid"), ("email", "e AT dev DOT corp DOT test")]),
    ("Pinned to flagkit@6.2.1, from git@code.example:a/b.git, @property, look at foo.bar", []),
    ("Tel. +49 30 23125 919, 0049 (0)30 23125-041.", [("phone", "+49 30 23125 919"), ("phone", "0049 (0)30 23125-041")]),
    ("(415) 555-0106 206.555.0126 617-555-0199 +16175550133", [("phone", "(415) 555-0106"), ("phone", "+16175550133"), ("phone", "206.555.0126"), ("phone", "617-555-0199")]),
    ("020 7946 0547 07700 900770 030/23125664", [("phone", "020 7946 0547"), ("phone", "030/23125664"), ("phone", "07700 900770")]),
    ("Version 10.4.154.2, host 192.0.2.117, build 20240914-0934, 2024-05-01, ticket 1794-215, 1_000_126, line 415-555", []),
    ("SSN 926-30-0978, QQ 89 97 50 B, QQ655219A, 18 872 442 570", [("id_number", "18 872 442 570"), ("id_number", "926-30-0978"), ("id_number", "QQ 89 97 50 B"), ("id_number", "QQ655219A")]),
    ("at 213 Fallow Road, Marrowick, QX 31985 and works", [("address", "213 Fallow Road, Marrowick, QX 31985")]),
    ("Flat 17, 444 Larch Road, Quenstead, QV6 6ZX.", [("address", "Flat 17, 444 Larch Road, Quenstead, QV6 6ZX")]),
    ("803 PEWTER DRIVE, APT 25, PELLWORTH, ZQ 27719", [("address", "803 PEWTER DRIVE, APT 25, PELLWORTH, ZQ 27719")]),
    ("Calle Otter 975, 35467 Nordhollow The next. 576, rue du Heron, 36268 Saintmere and", [("address", "576, rue du Heron, 36268 Saintmere"), ("address", "Calle Otter 975, 35467 Nordhollow")]),
    ("Alderstraße 477, 67569 Lowfen senden. Nettleweg 114, 77498 Ostermoor", [("address", "Alderstraße 477, 67569 Lowfen"), ("address", "Nettleweg 114, 77498 Ostermoor")]),
    ("", []),
])
def test_shapes(text, want):
    assert kinds(text) == sorted(want)


GIVEN, FAMILY = ["Ada", "Grace", "Mark", "Zoë", "Otto"], ["Byronwick", "Hopperdahl", "Velmström", "Quillsby"]


def corpus():
    docs, n = [], 0
    for g in GIVEN:
        for f in FAMILY:
            n += 1
            docs.append((n, f"I asked {g} {f} about the lock. Write to {ps.fold(g)}.{ps.fold(f)}@example.org if it comes back."))
    for i in range(60):
        docs.append((100 + i, f"Grace Period timers and Mark Sweep passes are unrelated. Use a Bloom Filter or a Merge Sort here. The mark {i} gets a grace period."))
    for i in range(40):  # text without names, as most text is
        docs.append((200 + i, f"the job reads block {i} of every file and writes it back in order; " * 6))
    docs += [
        (900, "Thanks to Ada K. Byronwick for the trace. Owner: Velmström, Zoë"), (901, "Signed: MARK QUILLSBY, Otto van Hopperdahl, Ada O'Byronwick, Ada Quillsby-Velmström"),
        (902, "I asked Ines Newdahl about the lock.\nThe id 123456789 is no number of a person."), (903, None), (904, ""), (905, "x" * 60000), (906, "I asked Ada Byronwick about the lock. Ada Byronwick again."), (906, "I asked Ada Byronwick about the lock. Ada Byronwick again."),
    ]
    return docs


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in corpus()], DOC)
    return ps.find_personal(df).cache(), df


def test_names_are_told_by_terms_and_contexts(found):
    by = {}
    for r in found[0].where("pii_kind = 'person_name'").collect():
        by.setdefault(r.doc_id, set()).add(r.found_text)
    assert by[900] == {"Ada K. Byronwick", "Velmström, Zoë"}
    assert by[901] == {"MARK QUILLSBY", "Otto van Hopperdahl", "Ada O'Byronwick", "Ada Quillsby-Velmström"}
    assert by[902] == {"Ines Newdahl"} and by[906] == {"Ada Byronwick"}
    assert all(by[i + 1] for i in range(20)) and not any(i in by for i in range(100, 160))


def test_positions_and_redaction(spark, found):
    f, df = found
    texts = dict(corpus())
    for r in f.collect():
        assert texts[r.doc_id][r.start : r.stop] == r.found_text
    red = {r.doc_id: r.text for r in ps.redact(df.dropDuplicates(["doc_id"]), f.dropDuplicates()).collect()}
    assert red[1] == "I asked [PERSON_NAME] about the lock. Write to [EMAIL] if it comes back."
    assert red[903] is None and red[904] == "" and red[905] == "x" * 60000 and red[100] == texts[100]
    assert red[902].endswith("The id 123456789 is no number of a person.")


def test_numbers_without_separators_need_their_context(spark):
    docs = [(i, f"SSN 9{i:02}-11-2233 was printed.", "z", 1) for i in range(10)] + [(50, "SSN 912345678 was printed.", "z", 1), (51, "Offset 912345678 is fine.", "z", 1)]
    got = {(r.doc_id, r.pii_kind, r.found_text) for r in ps.find_personal(spark.createDataFrame(docs, DOC)).collect()}
    assert (50, "id_number", "912345678") in got and not any(x[0] == 51 for x in got) and len(got) == 11


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert ps.find_personal(df).count() == 0 and rows(ps.redact(df, ps.find_personal(df))) == []


def test_names_in_any_letter_case(spark):
    extra = [(950, "thanks to ada byronwick for the trace"), (951, "ADA BYRONWICK signed"), (952, "owner: byronwick, ada k. and otto van hopperdahl"), (953, "Ask ada Byronwick, or zoë velmström."), (954, "a grace period, a mark sweep, ada lock")]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in corpus() + extra], DOC)
    got = {(r.doc_id, r.found_text) for r in ps.find_personal(df).where("doc_id >= 950").collect()}
    assert got == {(950, "ada byronwick"), (951, "ADA BYRONWICK"), (952, "byronwick, ada k."), (952, "otto van hopperdahl"), (953, "ada Byronwick"), (953, "zoë velmström")}


def test_copies_count_once(spark):
    """A text under many ids makes its names no commoner, and each id gets its rows."""
    copies = [(2000 + i, "I asked Ines Newdahl about the lock.\nThe id 123456789 is no number of a person.") for i in range(400)]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in corpus() + copies], DOC)
    got = ps.find_personal(df).where("doc_id >= 2000 or doc_id = 902").collect()
    assert len(got) == 401 and {r.found_text for r in got} == {"Ines Newdahl"}


def test_many_particles_and_far_contexts():
    text = "von " * 3 + "x"
    assert ps.name_pairs("Otto A. van der von der zu van Hopperdahl", [])[0][2:] == ("Otto", "Hopperdahl") and ps.name_pairs(text, []) == []
    long = "w" * 300 + " " * 200
    assert ps._left(long + "Ada", len(long)) == ("w" * 300, "^ " + "w" * 300) and ps._right("Ada" + " " * 200 + "z" * 300 + " y", 3) == "z" * 300 + " y"
