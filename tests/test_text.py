from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import grounding, jurisdiction, terms
from lexloom.operators.extract_classes import EXTRACTORS


def test_repair(one):
    fixed = one("l N V 0 l C E INV-1O23 {name:str}due", tx.repair_scanned_text)
    assert fixed == "INVOICE INV-1023 due"
    assert one("Landmark", tx.repair_scanned_text) == "Iandmark"
    assert one("Landmark", lambda c: tx.repair_scanned_text(c, "case_sensitive")) == "Landmark"


def test_dates(one):
    assert one("03/04/2021", tx.iso_date) == "2021-04-03"
    assert one("12/25/2021", tx.iso_date) == "2021-12-25"
    assert one(" march 4, 2021 ", tx.iso_date) == "2021-03-04"
    assert one("1/2/70", tx.iso_date) == "1970-02-01"
    assert one("1/2/68", tx.iso_date) == "2068-02-01"
    assert one("31 June 2021", tx.iso_date) is None


def test_amounts(one):
    assert one("about $ 1,234.50 now", tx.currency_amount) == 1234.5
    assert one(",", tx.currency_amount) is None
    assert one("EUR -12.5", tx.digits_amount) == -12.5
    assert one("{total}", tx.digits_amount) is None


def test_rounding(one):
    assert one("0.125", lambda c: tx.round_even(c.cast("double"), 2)) == 0.12
    assert one("1234567.375", lambda c: tx.round_even(c.cast("double"), 2)) == 1234567.38


def test_distinct_keeps_first_spelling(one):
    got = one("b A a B c", lambda c: tx.distinct_ignore_case(F.split(c, " ")))
    assert got == ["b", "A", "c"]


def test_snippet(one):
    text = "x" * 150 + " Needle " + "y" * 150
    got = one(text, lambda c: tx.snippet(c, F.lit("needle")))
    assert got == "x" * 99 + " Needle " + "y" * 99
    assert one(text, lambda c: tx.snippet(c, F.lit("absent"))) is None


def test_reply_repair(one):
    assert one('```json\n{"a": 1}\n```', tx.clean_reply) == '{"a": 1}'
    assert one('So: {"a": 1} ok', tx.clean_reply) == '{"a": 1}'
    assert one('{"a": [1,],}', tx.clean_reply) == '{"a": [1]}'
    assert one("nothing", tx.clean_reply) is None


def test_expansion(one):
    def join(extra):
        return one("payment", lambda c: tx.join_expansion(c, F.lit(extra)))

    assert join("fees due") == "payment fees due"
    assert join("Payment") == "payment"
    assert join("Payment of fees") == "Payment of fees"
    assert join("") == "payment"


def test_grounding_score(one):
    text = (
        "The Plaintiff filed the claim in the district court [Page 2]. "
        "The Defendant denied every claim that was raised there [UNSUPPORTED: none]. "
        "The Agreement was signed by both of the parties then. Too short."
    )
    assert one(text, grounding.grounding_score) == 0.33
    assert one("Nothing to see.", grounding.grounding_score) == 1.0


def test_jurisdiction(one):
    text = "Under 28 U.S.C. 1331 in E.D. Wis. and Wis. Stat. 100.18."
    assert one(text, jurisdiction.jurisdiction_tags) == ["federal", "federal:EDWI", "state:WI"]
    assert one("in S.D.N.Y. today", jurisdiction.jurisdiction_tags) == []
    tags = one(text, lambda c: jurisdiction.primary_tag(jurisdiction.jurisdiction_tags(c)))
    assert tags == "federal:EDWI"


def test_terms(one):
    text = '"Lender" means First Bank of Ohio; "lender" means Second Bank; sold to Acme Corp (the "Buyer").'
    got = one(text, lambda c: terms.last_wins(terms.term_candidates(c)))
    assert [(p["term"], p["definition"]) for p in got] == [
        ("Buyer", "Acme Corp"), ("Lender", "First Bank of Ohio"),
    ]


def test_annotation_is_sequential(one):
    pairs = F.array(
        F.struct(F.lit("Loan Deed").alias("term"), F.lit("an old Deed of 1999, as amended").alias("definition")),
        F.struct(F.lit("Deed").alias("term"), F.lit("a paper").alias("definition")),
    )
    got = one('The Loan Deed and "Deed".', lambda c: terms.annotate(c, pairs))
    assert got == 'The Loan Deed [paper] [old Deed [paper] of 1999] and "Deed".'


def test_class_extractors(one):
    got = one(
        "Effective Date: May 1, 2020\nThis Agreement is between Acme Inc and Beta LLC\n"
        "governed by the laws of the State of Ohio.\nGrantor: Jo Doe\n",
        EXTRACTORS["contract"],
    )
    assert got["effective_date"] == "May 1, 2020"
    assert got["party_a"] == "Acme Inc"
    assert got["governing_law"] == "Ohio"
    got = one("JO DOE, Plaintiff, v. ACME CORP, and BETA LLC, Defendants.\nCOUNT I fraud", EXTRACTORS["legal_complaint"])
    assert got["plaintiffs"] == ["JO DOE"]
    assert got["defendants"] == ["ACME CORP", "BETA LLC"]
    assert got["claims"] == ["I fraud"]


def test_class_extractor_lists_are_whole(one):
    demands = "\n".join(f"You must return item number {i} soon." for i in range(30))
    got = one(f"Cease and desist.\nFrom: Firm\n{demands}", EXTRACTORS["legal_notice"])
    assert len(got["required_actions"]) == 30 and got["notice_type"] == "cease_and_desist"
    got = one("28 U.S.C. § 1391 " + " ".join(f"{i} U.S.C. § {i}5," for i in range(1, 40)), EXTRACTORS["legal_complaint"])
    assert len(got["statutes"]) == 40 and got["venue"] == "Venue alleged under 28 U.S.C. § 1391"
