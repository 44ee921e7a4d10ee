"""Extraction, merging, naming: hand-written cases on a small set of tables."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import fields as X
from paperloom.functions import naming as N
from paperloom.functions import pythonic as P
from paperloom.functions import quality as Q
from paperloom.functions import rules as R
from paperloom.functions.dialect import SPARK


def best(spark, find, rows):
    found = [find(t, m or {}) for t, m in rows]
    return [(f.value, round(f.confidence, 3)) if f.value is not None else None for f in found]


def plain_date(text, meta):
    return X.find_date(text, meta, context=False)


def test_dates(spark):
    rows = [("Issued 2019-03-15 and 03/16/2019", {}), ("March 15, 2019", {}), ("on 15 July 2023", {}), ("15/07/2023", {}), ("in 1949 or 2036", {}), ("in 1950", {}), (None, {"creationDate": "D:20200102030405Z"}), ("2023-02-30", None), ("", {}), ("x" * 4999 + " 2019-03-15", {})]
    assert best(spark, plain_date, rows) == [("2019-03-15", 0.95), ("2019-03-15", 0.9), ("2023-07-01", 0.7), ("2023", 0.3), None, ("1950", 0.3), ("2020-01-02", 0.6), ("2023", 0.3), None, None]


def test_date_context():
    assert P.date_in_context("Published: 2019-03-15")[:2] == ("2019-03-15", 1.0)
    assert P.date_in_context("updated 12.05.2018")[1] == pytest.approx(1.0)  # date and dated both raise it
    assert P.date_in_context(None) == (None, 0.0, "none_found")


def test_authors(spark):
    rows = [("Author: John Smith\n", {}), ("Dr. Jane Doe wrote", {}), (None, {"author": "Jane A. Doe."}), ("x", {"author": "Microsoft Word"}), (None, None), ("Smith, John\n", {})]
    assert best(spark, X.find_author, rows) == [("John Smith", 0.85), ("Jane Doe", 0.7), ("Jane A. Doe", 0.7), None, None, ("Smith, John", 0.75)]


def test_identifiers(spark):
    rows = [("doi: 10.1000/xyz123", {}), ("ISBN 978-0-306-40615", {}), ("DNV-RP-C203", {}), ("MEPC.328(76)", {}), (None, {"subject": "ABC-1234"}), ("", {})]
    got = best(spark, X.find_identifier, rows)
    assert got[0] == ("10.1000/xyz123", 0.95) and got[2][0] == "DNV-RP-C203" and got[3][0] == "MEPC.328(76)" and got[4] == ("ABC-1234", 0.55) and got[5] is None


def test_organisations(spark):
    rows = [("DNV GL Rules for ships", {}), ("Lloyd's Register of shipping", {}), ("your first hours", {}), ("by LR, 2020", {}), (None, {"author": "Equinor"}), (None, None)]
    assert best(spark, X.find_organisation, rows) == [("DNV", 0.75), ("LR", 0.75), None, ("LR", 0.6), ("Equinor", 0.7), None]


def test_titles(spark):
    rows = [("short\nA significant first line here\n", {}), ("x", {"title": "A proper title"}), ("x", {"title": "untitled"}), ("Title: The stability of ships\n", {}), (None, None), ("confidential paper of ours\n", {})]
    assert best(spark, X.find_title, rows) == [("A significant first line here", 0.35), ("A proper title", 0.65), None, ("The stability of ships", 0.75), None, None]


@pytest.mark.parametrize("raw, want", [("DNV — Rules for Steel Ships (Part 3)", "dnv_rules_for_steel_ships_part_3"), ("Wärtsilä 12V46F Engine Manual", "wartsila_12v46f_engine_manual"), ("con", "con_file"), ("", ""), (None, ""), ("a\nb", "ab"), ("x" * 90, "x" * 76), ("Straße/№", "strasse№"), ("Отчёт о судне «Заря»", "otchiot_o_sudne_«zaria»"), ("Έκθεση πλοίου", "ekthese_ploiou"), ("Größe Ångström Łódź", "grosse_angstrom_lodz"), ("a+b=c'~`d", "a+b=c'~`d"), ("x" * 75 + "__y", "x" * 75)])
def test_sanitised(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(F.expr(N.sanitised(SPARK, "s"))).first()[0] == want


def test_names_by_template(spark):
    blank = {f: None for f in R.ALL_FIELDS}

    def name(template=R.CONFIG_TEMPLATE, separator="_", file_id="0123456789abcdef", path="/in/Scan 7.PDF", length=80, lower=True, accents=False, **given):
        values = {f: ({"value": given[f]} if f in given else None) for f in blank}
        schema = "file_id string, original_path string, target_dir string, merged struct<" + ", ".join(f"{f}:struct<value:string>" for f in blank) + ">"
        spark.createDataFrame([(file_id, path, None, values)], schema).createOrReplaceTempView("state_for_names")
        from paperloom.plans.reference import names_with

        return spark.sql(names_with(template, separator, length, lower, not accents)(SPARK).replace("@documents_state", "state_for_names")).first().canonical

    assert name(maritime_document_type="class_certificate", organization="LR", vessel_name="MV Ann", title="The safety of a ship at sea and land", date="15/07/2023") == "lr_mv_ann_the_safety_ship_sea_15_07_2023.pdf"
    assert name(maritime_document_type="contract", title="Charter", date="2020-01-02") == "charter_2020_01_02.pdf"
    assert name(document_type="report", organization="DNV", title="Hull of the ship", year="2019") == "report_dnv_hull_the_ship_2019.pdf"  # no domain type: the configured template
    assert name(maritime_document_type="nowhere", organization="DNV", title="Hull", year="2019") == "dnv_hull_2019.pdf"
    assert name("{year} {org} no {report_id}{nothing}", "-", organization="DNV", report_id="A/1", year="2020") == "2020-dnv-no-a1.pdf"
    assert name("{author_full}", author="Bjørn Ø.", accents=True, lower=False) == "Bjørn_Ø.pdf" and name("{author_last}", author="Smith, John et al.") == "smith.pdf"
    assert name() == "scan_7.pdf" and name(path=None) == "0123456789ab.pdf" and name("{title_full}", length=12, title="abcdefgh ijk") == "abcdefgh.pdf"


def test_broad_domain(spark):
    df = spark.createDataFrame([("invoice",), ("",), ("zebra",), ("report",)], "t string")
    assert [r[0] for r in df.select(F.expr(N.broad_domain(SPARK, "t"))).collect()] == ["financial", "academic", "general", "academic"]
    with pytest.raises(ValueError):
        N.folder(SPARK, "nowhere")


def test_quality():
    good = "The vessel shall be designed and built in accordance with the rules of the class society. " * 5
    assert Q.signals(good)[0] > 0.5 and Q.signals("@@@@@@@@####!!!!$$$$@@@@####")[0] < 0.7
    assert Q.signals(None)[0] == Q.signals("")[0] == Q.signals("123456789")[0] == 0.0
    assert Q.signals("12345678901")[2] is None  # no word of three letters: the signal is left out


def test_tables():
    assert len(R.COMMON_WORDS) == 192 and len(R.ORGANISATIONS) == 79 and len(R.DOMAIN) == 44 and len(R.TEMPLATES) == 45 and sum(map(len, R.DOMAIN.values())) == 139
    assert R.TYPE_DOMAIN["invoice"] == "commercial" and R.TEMPLATES["contract"] == "{org}_{title_short}_{date}"


TYPED = ["dear mr smith", "doi:10.1000/182", "arxiv:1234", "invoice #4411", "doi: 10.1", "et al. (2010)", "et al.b", "class rules", "rules for steel ships", "invoice no 5", "dp-2", "fi-fi", "p&id", "ph.d. thesis", "k-epsilon", "non-conformity", "qualité", "dnv-ru", "DNV RP"]


def test_word_edges_of_types():
    """Patterns are matched whole: an edge after a sign needs a letter or digit beside it."""
    got = {t: X.find_generic_type(t).value for t in TYPED[:7]}
    assert got == {"dear mr smith": "letter", "doi:10.1000/182": "research_paper", "arxiv:1234": "research_paper", "invoice #4411": "invoice", "doi: 10.1": "other", "et al. (2010)": "other", "et al.b": "research_paper"}
    assert X.find_generic_type("invoice #4411").confidence == pytest.approx(7 / 9 * 0.85) and X.find_generic_type("invoice # 4411").confidence == pytest.approx(3 / 9 * 0.85)
    assert X.find_generic_type(None) == X.Found("other", 0.1, "heuristic", "no_text")
    domain, broad, sub = X.find_domain_type("rules for classification of steel ships, part 3: hull", X.find_organisation("by dnv gl", {}))
    assert (domain.value, broad.value, sub.value) == ("class_rules", "classification_societies", "DNV") and domain.confidence == pytest.approx(8 / 20 * 0.85)
    assert [f.value for f in X.find_domain_type("nothing of the kind", X.find_organisation("", {}))] == ["other", "general", ""]


def test_literal_guards_hold(spark, sf):
    texts = [t.lower() for t in TYPED] + [r.raw_text.lower() for r in spark.read.parquet(f"{sf}/corpus.parquet").where("raw_text is not null").collect()]
    for signals in (X.GENERIC, X.DOMAIN):
        assert all(signals.score(t) == signals.score(t, every=True) for t in texts)


def test_file_response(spark):
    from paperloom.functions.responses import with_suggested_name

    want = {
        '```\nFILENAME: "Annual Report 2020.pdf"\nbecause\n```': "annual_report_2020", "ceaa_corteva_electronic_access_agreement_2020": "corteva_electronic_access_agreement_2020", "aca_annual_class_audit_final": "annual_class_audit",
        "srihariOptionLetter": "srihari_option_letter", "word_" * 30: ("word_" * 12).strip("_"), "annualinspectionreportofthevessel": "annualinspection_report_ofthevessel", "filename: 'A  B-c.PDF' ": "a_b_c", "a_b_c_d": "a_b_c_d",
        "new_copy_final": "", "": "", None: "",
    }
    df = spark.createDataFrame([(k,) for k in want], "r string")
    assert {r.r: r.suggested_name for r in with_suggested_name(df, "r").collect()} == want


def test_responses():
    from paperloom.functions.responses import RESPONSE_FIELDS, response_values

    def read(raw):
        values, year, words = response_values(raw)
        return dict(zip(RESPONSE_FIELDS, values)), year, words

    fields, year, words = read('{"title": " A title ", "author": null, "date": "2019-03-15", "keywords": ["a", "b, c", ""], "summary": "x, }"}')
    assert fields["title"] == "A title" and fields["author"] is None and year == "2019" and words == ["a", "b, c"] and fields["summary"] == "x, }"
    assert read('```json\n{"title": "T", "keywords": "a, b,, c",}\n```')[0]["title"] == "T" and read('{"keywords": "a, b,, c"}')[2] == ["a", "b", "c"]
    assert read('{"a": {"b": {"c": 1}}, "title": "deep"}')[0]["title"] == "deep"  # whole JSON is read at any depth
    assert read('Sure: {"title": "T", "x": {"y": 1},} and more')[0]["title"] == "T"
    for broken in (None, "", "   ", "I cannot read this page.", '{"title": "cut', "[1, 2]", "12", '{"title": ""}'):
        assert read(broken) == (dict.fromkeys(RESPONSE_FIELDS), None, [])
    assert read('{"keywords": "' + ",".join("abcdefghijklm") + '"}')[2] == list("abcdefghij")


def test_reconciled(spark):
    from paperloom.plans.fields import _agreed, merged_keywords, reconciled

    def merged(*cands):
        df = spark.createDataFrame([(list(cands),)], "c array<struct<value:string,confidence:double,source:string,method:string>>")
        r = df.select(_agreed(reconciled(F.col("c"))).alias("m")).first().m
        return r.value, round(r.confidence, 6), r.source, r.method

    m, v, h = ("DNV", 0.7, "metadata", "m"), ("dnv.", 0.8, "vlm", "v"), ("ABS", 0.8, "heuristic", "h")
    assert merged(m) == ("DNV", 0.7, "metadata", "m") and merged(m, h) == ("ABS", 0.8, "heuristic", "h")
    assert merged(m, v) == ("dnv.", 0.9, "vlm+cross_validated", "v") and merged(m, v, h) == ("dnv.", 0.8, "vlm", "v")  # only the two best are compared
    assert merged(("A", 0.95, "a", "a"), ("a", 0.9, "b", "b")) == ("A", 0.98, "a+cross_validated", "a")
    assert merged(("  ", 0.9, "a", "a"), (None, 0.9, "b", "b")) == (None, 0.0, "none", "no_candidates") == merged()
    assert merged(("...", 0.9, "a", "a"), ("!!", 0.8, "b", "b"))[1] == 0.9  # nothing is left to agree on
    assert merged(("x .", 0.9, "a", "a"), ("x", 0.8, "b", "b"))[1] == 0.9  # a blank before dropped punctuation stays
    assert merged(("Größe", 0.9, "a", "a"), ("GRÖSSE", 0.8, "b", "b"))[1] == 0.9 and merged(("Wärme", 0.9, "a", "a"), ("wärme!", 0.8, "b", "b"))[1] == 0.98
    words = spark.createDataFrame([([("b", 0.7), ("A", 0.7), ("a", 0.5), ("c", 0.9)],)], "k array<struct<value:string,confidence:double>>").select(merged_keywords(F.col("k")).alias("k")).first().k
    assert [w.value for w in words] == ["c", "b", "A"]


def test_otsu_and_font():
    histogram = [0] * 256
    histogram[10], histogram[200] = 50, 50
    assert 10 <= P.otsu_threshold(histogram) < 200 and P.otsu_threshold([0] * 256) == 0
    assert X.largest_font_title([(18.0, "A large title"), (10.0, "body text")]) == "A large title"
    assert X.largest_font_title([(12.0, "No large title")]) is None and X.largest_font_title(None) is None
