"""Column functions on example values, and properties on generated ones."""

import datetime
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import contact, keys, place, privacy, text, times, urls
from siftwell.operators import search


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("x")).collect())]


CASES = [
    (lambda c: text.normalize_name(c, unicode_fold=True), {"Acme, Inc.": "acme", "  ACME L.L.C. ": "acme", "Ａcme Corp": "acme", "École & Fils Ltd": "école fils",
                                                         "LLC": None, "": None, None: None, "Smith d/b/a Jones Co.": "smith jones"}),
    (text.normalize_person_name, {"Dr. Mr. José  Ñuñez, Jr.": "jose nunez jr", "O’Brien": "o brien", "Miss": ""}),
    (contact.normalize_domain, {"https://www.Acme.com/x?y": "acme.com", "acme.com": "acme.com", "http://user@acme.co.uk:80": "acme.co.uk", "localhost": None, None: None}),
    (contact.normalize_phone, {"(212) 555-0100": "+12125550100", "+1 212.555.0100 ext. 4": "+12125550100", "1-212-555-0100": "+12125550100", "555-0100": None,
                               "112 555 0100": None, "+44 20 7946 0958": "+442079460958", "call me": None}),
    (contact.normalize_email, {" Info@Acme.COM ": "info@acme.com", "a@b": None, "x y@z.com": None}),
    (place.normalize_state, {"ny": "NY", " New York. ": "NY", "puerto rico": "PR", "Ontario": None, "": None}),
    (lambda c: F.to_json(place.parse_location(c)), {
        "Albany, NY 12207, USA": '{"city":"Albany","state":"NY","postal":"12207"}', "New York": '{"state":"NY"}', "Salt Lake City Utah": '{"city":"Salt Lake City","state":"UT"}',
        "12207-1234": '{"postal":"12207-1234"}', "Suite 5, Albany, New York": '{"city":"Suite 5, Albany","state":"NY"}', "Toronto, Ontario": '{"city":"Toronto, Ontario"}'}),
    (lambda c: F.to_json(place.place_with_state(c)), {"Houston_TX": '{"place":"Houston","state":"TX"}', "Houston, TX 77002": '{"place":"Houston","state":"TX","zip":"77002"}',
                                                      "Charlotte North Carolina": '{"place":"Charlotte","state":"NC"}'}),
    (text.normalize_keyword, {"A/C & Heating Services": "a c and heating service", "Glass Companies": "glass company", "Fences": "fence"}),
    (text.clean_tags, {"Roofing; roofing |N/A, Siding": "Roofing | Siding", "none": None}),
    (text.normalize_city, {"new york city": "New York", "ALBANY!": "Albany", "st. paul": "St Paul"}),
    (privacy.mask_text, {"a@x.com": "*@x.com", "mail john.doe@acme.com now": "mail j***@acme.com now", "call 212-555-0100": "call 21****0100", "+1 (743) 555-3824": "+17*****3824",
                         "1-212-555-0100 and 2125550101": "12*****0100 and 21****0101", "12-34": "12-34", "": "", None: None}),
    (urls.normalize_external_url, {"acme.com/a": "https://acme.com/a", "mailto:x@y.z": None, "HTTP://Acme.com/?utm_x=1&a=2": "http://acme.com/?a=2", "/local": None}),
    (urls.clean_social_url, {"https://facebook.com/sharer/x": None, "//www.instagram.com/acme/?locale=en": "https://www.instagram.com/acme", "https://facebook.com/p": None}),
    (contact.clean_email, {"Info@Acme.com.": "info@acme.com", "x@sub.example.com": None, "noreply@acme.com": None, "logo@2x.png": None, "no-reply-1@acme.com": None}),
    (times.parse_due_date, {"2024-05-06": datetime.datetime(2024, 5, 6), "5/6/2024 3:30 PM": datetime.datetime(2024, 5, 6, 15, 30), "May 6, 2024": datetime.datetime(2024, 5, 6),
                            "March 6, 2024": datetime.datetime(2024, 3, 6), "soon": None, "2024-13-40": None}),
]


@pytest.mark.parametrize("fn, cases", CASES, ids=range(len(CASES)))
def test_examples(spark, fn, cases):
    assert run(spark, fn, list(cases)) == list(cases.values())


def test_identity_rules(spark):
    rows = [("rfp", "Reg", "reg_7", None), ("company", "Reg", "7", "abc"), (None, "Reg", None, "abc"), ("company", None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, s string, e string, f string")
    got = [r[1] for r in sorted(df.select("i", keys.lead_identity(F.col("k"), F.col("s"), F.col("e"), F.col("f"))).collect())]
    assert got == ["src:reg:7", "fp:abc", "fp:abc", None]


def test_identity_is_exact(spark):
    """Two spellings of a company are the same only if domain, phone and email agree."""
    rows = [("Acme Inc.", "www.acme.com", "(212) 555-0100", "A@acme.com"), ("ACME", "https://acme.com/x", "+12125550100", "a@acme.com"), ("ACME", None, "+12125550100", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, d string, p string, e string")
    prints = [r[1] for r in sorted(df.select("i", keys.fingerprint(F.col("n"), F.col("d"), F.col("p"), F.col("e"))).collect())]
    assert prints[0] == prints[1] != prints[2]


def test_category_terms(spark):
    terms = run(spark, lambda c: search.category_variations(c)["plain"], ["Roofing contractors", "A/C", "electrical & plumbing", "Contractors"])
    assert terms[0] == ["roofing", "roofer", "roofers"]
    assert terms[1] == ["ac", "hvac", "air conditioning", "cooling", "heating"]
    assert {"electrical", "plumbing", "plumber", "wiring"} <= set(terms[2])
    assert terms[3] == []
    worded = run(spark, lambda c: search.category_variations(c)["contractor"], ["Roofing contractors", "Contractors"])
    assert worded[0][:3] == ["roofing contractors", "roofing contractor", "roofer contractors"]
    assert worded[1] == ["contractors", "contractor"]


TEXTS = st.lists(st.text(alphabet=string.ascii_letters + string.digits + " .,&-@/()+éÑ", max_size=40), min_size=1, max_size=60)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=TEXTS)
def test_normalisers_are_idempotent(spark, values):
    for fn in (text.normalize_keyword, contact.normalize_email, contact.normalize_phone, contact.normalize_domain, text.slug, place.normalize_state):
        once = run(spark, fn, values)
        assert run(spark, fn, once) == once


@SETTINGS
@given(values=TEXTS)
def test_masking_leaves_no_address(spark, values):
    import re

    for masked in run(spark, privacy.mask_text, [f"{v} bob@acme.com 212-555-0100" for v in values]):
        assert "bob@acme.com" not in masked and not re.search(r"\b212-555-0100\b", masked)
