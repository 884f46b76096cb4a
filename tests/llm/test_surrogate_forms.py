"""Surrogates of names, national numbers, other scripts and equal numbers in other dress."""

import re

from spikeframe.llm import surrogates


def rewrite(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert surrogates.collisions(df).count() == 0
    return surrogates.rewritten(df).orderBy("doc_id").collect()


def test_whole_names_go(spark):
    texts = ["Mrs Anna Maria Schmidt came.", "Mr. J. Smith left", "Prof. Dr. Ludwig van Beethoven played", "Dr Who K. Rowling sat",
             "Hello, my name is Carla Jensen and", "Dear Bob Miller, hi", "Mr J Smith ate", "Frau Dr. Öztürk-Weiß", "Mr 王小明"]
    names = ["Anna Maria Schmidt", "J Smith", "Ludwig Beethoven", "Rowling", "Carla Jensen", "Bob Miller", "J Smith",
             "Öztürk-Weiß", "王小明"]
    for r, gone in zip(rewrite(spark, *texts), names):
        assert len(r.entities) == 1 and r.entities[0].kind == "person"
        assert not set(re.findall(r"\w+", r.text)) & set(re.findall(r"\w+", gone)), r.text
    got = rewrite(spark, texts[4])[0].text
    assert re.fullmatch(r"Hello, my name is [A-Z]\w{3}a [A-Z]\w{4}n and", got)


def test_national_phones(spark):
    for r in rewrite(spark, "555 123 4567", "0171 1234567", "01 23 45 67 89", "(030) 123 4567", "0171/1234567"):
        assert [e.kind for e in r.entities] == ["phone"] and r.text != r.entities[0].value
        assert re.sub(r"\d", "", r.text) == re.sub(r"\d", "", r.entities[0].value)
    assert all(not r.entities for r in rewrite(spark, "in 2024 we had 100 200 300 and 3.14159", "2024-01-15"))


def test_every_script(spark):
    for value in ("用户名@例子.com", "مستخدم@مثال.com", "משתמש@דוגמה.com", "ñçßøåłžđ@ñß.com", "पता@उदाहरण.com", "한국어@한국.com", "𠀀𠀁@x.com"):
        got = rewrite(spark, f"to {value}.")[0]
        assert [e.value for e in got.entities] == [value]
        new = got.entities[0].surrogate
        assert len(new) == len(value)
        assert all(a != b for a, b in zip(new, value[:-4]) if b not in "@."), (value, new)
        assert new.endswith(".com")


def test_equal_numbers_in_other_dress(spark):
    pairs = [("+1 286 555 5136", "+12865555136"), ("+49 171 1234567", "+491711234567"),
             ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000")]
    for a, b in pairs:
        one, two = rewrite(spark, a, b)
        assert re.sub("[ ]", "", one.text) == two.text != b and one.text[:2] == a[:2]


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(digits)) % 10 == 0


def test_what_is_no_personal_data(spark):
    texts = ["pi 3.1415926535897932 and e 2,7182818284590452", "123.4567 or 100.0000", "stamp 1700000000000", "Major League Baseball",
             "the Don River", "Sig Value", "Dear Customer Service", "Author: The Guardian", "Name: Total Amount"]
    for r in rewrite(spark, *texts):
        assert not r.entities and r.text == texts[r.doc_id], r.entities


def test_cards_keep_their_check_digit(spark):
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "4111 1111 1111 1112", "6011000990139424"]
    got = rewrite(spark, *cards)
    for card, r in zip(cards, got):
        assert [e.kind for e in r.entities] == ["card"] and r.text != card and r.text[0] == card[0]
        assert re.sub(r"\d", "", r.text) == re.sub(r"\d", "", card) and luhn(r.text) == luhn(card)
    assert len({r.text for r in got}) == len(cards)
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('4000 0000 0', lpad(id div 10, 3, '0'), ' 000', id % 10) AS text")
    assert surrogates.collisions(many).count() == 0


def test_the_key_is_given(spark):
    import pytest

    df = spark.createDataFrame([(1, "a.b@c.com")], "doc_id long, text string")
    key = spark.conf.get(surrogates.KEY)
    spark.conf.unset(surrogates.KEY)
    try:
        with pytest.raises(ValueError, match="key"):
            surrogates.rewritten(df)
        one, two = (surrogates.rewritten(df, key).first().text for key in ("a", "b"))
        assert one != two and surrogates.rewritten(df, "a").first().text == one
    finally:
        spark.conf.set(surrogates.KEY, key)
