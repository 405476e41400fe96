import unicodedata

import pytest
from pyspark.sql import functions as F

from linkquarry.functions import text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


NAMES = {
    "Orelee's Barbershop": "orelee s barbershop", "St. John's, Inc.!": "st john s inc", "AT&T Services": "at and t services", "Café & Crêperie Étoile SARL": "café and crêperie étoile sarl",
    "राम मार्केटिंग प्राइवेट लिमिटेड": "राम मार्केटिंग प्राइवेट लिमिटेड", None: "", "": "", "---": "", "!@#$%^&*()": "", "a_b": "a b", "  x   y ": "x y",
}


def test_normalize_name(spark):
    assert column(spark, NAMES, text.normalize_name) == list(NAMES.values())


def test_compatibility_forms(spark):
    values = ["ＡＢＣ Ｌｔｄ", "Ⅳ café", "plain", None]
    assert column(spark, values, lambda c: text.normalize_name(c, compose=True)) == [unicodedata.normalize("NFKC", v).lower() if v else "" for v in values]


LEGAL = {
    "Blue Horizon Pvt. Ltd.": "blue horizon", "Global Logistics Company Limited": "global logistics", "Private Limited": "private limited", "Foo Soc Anonyme": "foo",
    "Soc Anonyme": "soc anonyme", "Private Soc Anonyme Limited": "private soc anonyme", "Limited Foo Inc": "limited foo", "Inc": "inc", None: "",
}


def test_strip_legal(spark):
    assert column(spark, LEGAL, lambda c: text.normalize_name(c, strip_legal=True)) == list(LEGAL.values())


def test_legal_suffixes(spark):
    assert column(spark, ["acme pvt ltd", "plain", ""], text.legal_suffixes) == [["ltd", "pvt", "pvt ltd"], [], []]


def test_name_tokens(spark):
    assert column(spark, ["a b c health care", "", "aa aa"], text.name_tokens) == [["health", "care"], [], ["aa", "aa"]]


def test_normalize_address(spark):
    values = {"105 ELM ST, MORGANTON, NC": "105 elm street morganton nc", "---, , ///": "", None: "", "Plot No. 5, Main Rd.": "plot no 5 main road", "A & B": "a and b"}
    assert column(spark, values, text.normalize_address) == list(values.values())


HOUSES = {
    "126-B New Line Road, Morristown, TN": "126-b", "OH, Columbus, 5559 Orville Avenue": "5559", "H.No.16-11-23/37/A, Hyderabad, Telangana": "16-11-23/37/a", "303, 3rd Floor Sakar 5": "303",
    "Near X, 5 bis Rue Pierre Dignac": "5", "Near SBI ATM, MG Road, Bengaluru, Karnataka": None, "Plot No. 780, Somewhere": "780", "Street of 12 oaks": "12", "": None, None: None,
}


def test_house_number(spark):
    assert column(spark, HOUSES, text.house_number) == list(HOUSES.values())


def test_address_tokens(spark):
    assert column(spark, ["105 elm street near elm", ""], text.address_tokens) == [["105", "elm", "street"], []]


def pairs(spark, values, make):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string").select("i", make(F.col("a"), F.col("b")).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def test_similarities(spark):
    values = [("", ""), ("", "x"), ("a", "apollo"), ("same", "same"), ("kitten", "sitting"), ("é", "e"), ("a", "b")]
    assert pairs(spark, values, text.length_ratio) == pytest.approx([1, 0, 1 / 6, 1, 6 / 7, 1, 1])
    assert pairs(spark, values, text.edit_similarity) == pytest.approx([1, 0, 1 / 6, 1, 1 - 3 / 7, 0, 0])

    def cosine(a, b):
        return text.gram_cosine(a, b, text.grams(a, 2), text.grams(b, 2))

    assert pairs(spark, values, cosine) == pytest.approx([1, 1, 0, 1, 2 / (5**0.5 * 6**0.5), 1, 1])


def test_jaccard(spark):
    make = lambda a, b: text.jaccard(text.name_tokens(a), text.name_tokens(b))
    assert pairs(spark, [("apollo hospital delhi", "apollo clinic mumbai"), ("", "")], make) == pytest.approx([0.2, 0])


def test_bigram_dice_and_indel(spark):
    def dice(a, b):
        if a == b:
            return 1.0
        if len(a) < 2 or len(b) < 2:
            return 0.0
        x, y = [a[i : i + 2] for i in range(len(a) - 1)], [b[i : i + 2] for i in range(len(b) - 1)]
        return 2 * sum(min(x.count(g), y.count(g)) for g in set(x)) / (len(x) + len(y))

    def indel(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            last = 0
            for j, d in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    values = [("", ""), ("a", "b"), ("aaaa", "aaa"), ("banana", "ananas"), ("clinic", "klinik"), ("x", "x")]
    assert pairs(spark, values, text.bigram_dice) == pytest.approx([dice(*v) for v in values])
    assert pairs(spark, values, text.indel_ratio) == pytest.approx([indel(*v) for v in values])


def test_keys(spark):
    rows = spark.createDataFrame([("us ", " 1795", "westchester clinic"), ("US", None, "ab"), ("US", "5", "")], "c string, h string, n string")
    out = rows.select(text.house_prefix_key(F.col("c"), F.col("h"), F.col("n")), text.exact_key(F.col("c"), F.col("n")), text.prefix_key(F.col("c"), F.col("n")), text.house_key(F.col("c"), F.col("h"))).collect()
    assert [tuple(r) for r in out] == [("US::h_pref3::1795::wes", "US::name::westchester clinic", "US::pref5::westc", "US::house::1795"), (None, "US::name::ab", "US::pref5::ab", None), (None, "", "", "US::house::5")]
