"""Literal cases of cleaning, masking and templating."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from reviewlab import values as v
from reviewlab.functions import masking, text
from reviewlab.plans.jobs import additional_masking

X, Y, Z = F.col("x"), F.col("y"), F.col("z")


@pytest.mark.parametrize(("source", "want"), [
    ("a  b", "a\nb"), ("a b", "a b"), ("a\n\n b 　c", "a\nb\nc"), ("", ""), (None, None), ("dinner", "dinner"),
])
def test_runs_of_space_become_one_line_break(value, source, want):
    assert value(text.collapse_space(X), x=source) == want


def test_compat_class_also_holds_backslash_and_n(value):
    assert value(text.collapse_space(X, compat=True), x="dinner \\n a") == "di\ner\na"


def test_python_space_class_is_matched(value):
    every = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert value(text.strip(X), x=every + "a b" + every) == "a b"
    assert value(text.words(X), x=every.join(["a", "b"])) == ["a", "b"]


@pytest.mark.parametrize(("reply", "customer", "want"), [
    ("hi aa**님 bye", "aa**님", f"hi {v.CUSTOMER} bye"),
    ("aa** and aa* and aa", "aa**님", f"{v.CUSTOMER} and {v.CUSTOMER} and aa"),
    ("손님 아무개**님 하나 고객님", v.GUEST_ID, f"{v.CUSTOMER} {v.CUSTOMER} {v.CUSTOMER}"),
    ("abc", "a", f"{v.CUSTOMER}bc"),
    ("abc", "", "abc"),
    ("abc", None, "abc"),
    ("x (a+b)**님", "(a+b)**님", f"x {v.CUSTOMER}"),
    (None, "aa**님", None),
])
def test_customer_mask(value, reply, customer, want):
    got = value(masking.mask_customer(X, Y), x=F.lit(reply).cast("string"), y=F.lit(customer).cast("string"))
    assert got == want


def test_guest_pattern_finds_what_a_plain_scan_finds(value):
    plain = re.compile(r"[ㄱ-ㅎ가-힣\w]+(\*\*){0,} {0,}(님|고객님)")
    for sample in ["님님님", "가님나님다 님", "손님손님 고객님님", "a_1** 님b님", "님 님", "**님", "가나다 고객 고객님"]:
        assert value(masking.mask_customer(X, Y), x=sample, y=v.GUEST_ID) == plain.sub(v.CUSTOMER, sample)


@pytest.mark.parametrize(("reply", "store", "want"), [
    ("Cafe-Seoul opens", "Cafe-Seoul", f"{v.STORE} opens"),
    ("Cafe Seoul, Cafe, Seoul", "Cafe-Seoul", f"{v.STORE}, {v.STORE}, {v.STORE}"),
    ("CafeSeoul", "Cafe-Seoul", v.STORE),
    ("Cafe(X) and Cafe", "Cafe(X)", f"{v.STORE} and Cafe"),
    ("1+1, a.b axb", "1+1-a.b", f"{v.STORE}, {v.STORE} axb"),
    ("a-b--c a b  c", "a-b--c", f"{v.STORE} {v.STORE}"),
    ("price $1 \\E done", "\\E", f"price $1 {v.STORE} done"),
    ("none", None, "none"),
])
def test_store_mask(value, reply, store, want):
    assert value(masking.mask_store(X, Y), x=reply, y=F.lit(store).cast("string")) == want


def test_masks_are_stable(spark):
    rows = [("u1**님 at Cafe-A 010-12 @me a@b.com", "u1**님", "Cafe-A"), ("손님 오늘", v.GUEST_ID, "오늘")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    once = additional_masking(masking.mask_store(masking.mask_customer(X, Y), Z))
    first = df.select(once.alias("x"), "y", "z")
    assert [r.x for r in first.collect()] == [r[0] for r in first.select(once).collect()]


def test_listed_terms_first_listed_wins(value):
    assert value(masking.mask_terms(X, ["이삭", "이삭토스트"], "#"), x="이삭토스트 이삭") == "#토스트 #"
    assert value(masking.mask_terms(X, ["강*구"], "#"), x="강*구 구") == "# 구"
    assert value(masking.mask_terms(X, ["강*구"], "#", quote=False), x="강강구 구") == "# #"
    assert value(masking.mask_terms(X, [], "#"), x="abc") == "abc"
    assert value(masking.mask_terms(X, ["^a", "-b", "]"], "#"), x="^a a -b ]") == "# a # #"


@pytest.mark.parametrize("sample", [
    "see https://a.b.com/x/y now", "me@mail.com", "a.comb.com", "x:y@com", "dotcom", "acom", ".com", "com", "a.com:b.com@c.com",
    "welcome", "@.com.com/..com", "가.com나", "a\ncom", "becoming com.", "a::com//com..com:com",
])
def test_addresses_are_found_as_by_a_plain_scan(value, sample):
    plain = re.compile(r"[\w\/\:\.\@]+.com[\w\/\.]{0,}")
    assert value(masking.mask_urls_emails(X), x=sample) == plain.sub(v.CONTACT, sample)


def test_phones_and_handles(value):
    assert value(masking.mask_phones(X), x="2.34.5 010-12-가 12.3") == f"{v.CONTACT} {v.CONTACT} 1{v.CONTACT}"
    assert value(masking.mask_handles(X), x="@me_1!@ a@b.c") == f"{v.CONTACT}!@ a{v.CONTACT}.c"


def test_second_pass_masks_handles_before_addresses(value):
    got = value(additional_masking(X), x="파바 공덕점 배민 a@b.com 하늘을달리다 #식후감")
    assert got == f"{v.STORE} {v.PLACE} {v.ORGANISATION} a{v.CONTACT}.com {v.CUSTOMER} "


def test_tagged_terms(value):
    entities = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("type")) for w, t in [
        ("Seoul", "LOCATION"), ("Seoul Bank", "ORGANIZATION"), ("#x", "LOCATION"), ("A.B", "ORGANIZATION"), ("Ann", "PERSON")]])
    got = value(masking.mask_tagged(X, Y), x="Seoul Bank in Seoul, A.B AxB #x Ann", y=entities)
    assert got == f"{v.ORGANISATION} in {v.PLACE}, {v.ORGANISATION} AxB #x Ann"
    none = F.lit(None).cast("array<struct<word string, type string>>")
    assert value(masking.mask_tagged(X, Y), x="Seoul", y=none) == "Seoul"


def test_unmask_keeps_dollar_and_backslash(value):
    masked = f"[a-zA-Z]+{v.STORE} {v.CUSTOMER}{v.PLACE}<unk></s>\n{v.ORGANISATION}"
    assert value(masking.unmask_reply(X, Y, Z), x=masked, y="a$1", z="b\\2") == f"a$1 b\\2 {v.ORGANISATION}"


def test_decoded_text(value):
    assert value(text.clean_decoded(X), x="<bos>q<unused1> a <unused1>\n reply <eos> more <eos>") == "reply"
    assert value(text.clean_decoded(X), x="no marks ") == "no marks"
    assert value(text.clean_decoded(X, "plain"), x="</s> a<unk> b</s>") == "a b"


def test_prompt_styles(value):
    cols = [F.lit(c) for c in ("5", "4", "3", "good")]
    assert value(text.build_prompt(*cols)) == "맛:5 양:4 배달:3 리뷰:good"
    assert value(text.build_prompt(*cols, style="spaced")) == "맛: 5 양: 4 배달:3 리뷰:good"
    assert value(text.build_prompt(*cols, style="short")) == "리뷰: good"
    assert value(text.build_prompt(*cols, style="constant")) == "맛:5 양:5 배달:5 리뷰:good"


@pytest.mark.parametrize(("limit", "want"), [(2, ["a b"]), (3, ["a b", "c"]), (4, ["a b", "c d"]), (9, ["a b", "c d", ""])])
def test_lines_until_a_number_of_words(value, limit, want):
    assert value(text.truncate_sentences(X, limit), x=" a  b\nc d\n") == want


@pytest.mark.parametrize(("limit", "want"), [(2, ["ab"]), (3, ["ab", "c"]), (4, ["ab", "cd"]), (9, ["ab", "cd"])])
def test_lines_until_a_number_of_characters(value, limit, want):
    assert value(text.truncate_sentences(X, limit, "chars"), x=" ab\ncd ") == want


@pytest.mark.parametrize(("limit", "want"), [(2, "ab"), (3, "ab c"), (4, "ab cd"), (9, "ab cd ")])
def test_whole_text_until_a_number_of_characters(value, limit, want):
    assert value(text.truncate_text(X, limit, "chars"), x=" ab\ncd \n") == want


def test_characters_outside_the_basic_plane(spark):
    from reviewlab.operators.stats import char_frequency

    df = spark.createDataFrame([("a😀😀é",), ("é가😀",), ("plain",), ("",), (None,)], "t string")
    got = [tuple(r) for r in char_frequency(df, "t").collect()]
    assert got == [("😀", 3, 2), ("é", 2, 2)]
    assert char_frequency(df, "t", k=1).count() == 1


def test_normalise_and_tokenise(value):
    assert value(text.normalise_text(X), x="\u3000a\tb\n😀c \n") == "a b  c"
    assert value(text.normalise_text(X), x=" A-b가!é ") == "a b가"
    assert value(text.tokenise(X), x="Été_1, 맛있어요!") == ["été_1", "맛있어요"]
    assert value(text.tokenise(X), x="") == []
