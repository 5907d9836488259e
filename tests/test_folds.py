"""Folding of names, held against Python's own over every code point."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd

from larkspur.functions import text


def name(value):
    plain = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return " ".join(re.sub("[^a-z0-9 ]+", " ", plain.lower()).split())


def identity(value):
    bare = "".join(x for x in unicodedata.normalize("NFKD", value) if not unicodedata.combining(x))
    return re.sub("[^a-z0-9]", "", bare.casefold())


def test_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(pd.DataFrame({"c": codes, "t": ["x" + chr(c) + "Y" for c in codes]}))
    got = df.select("c", text.normalized_name(df["t"]).alias("n"), text.identity_key(df["t"]).alias("i")).toPandas()
    wrong = [hex(c) for c, n, i in got.itertuples(index=False) if n != name("x" + chr(c) + "Y") or i != identity("x" + chr(c) + "Y")]
    assert wrong == [] and len(got) == len(codes)


def test_names_of_many_letters(spark):
    names = ["Ĳsbrand ﬁtz ﬀ", "Straße ẞ", "Ａｎｎ　Ｌｅｅ", "ǆ Ǆ", "𝐀𝐧𝐧", "Đorđe Łukasz Ørsted", "é" * 50, "", None, "㏒ ½"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [tuple(r) for r in df.select(text.normalized_name(df["t"]), text.identity_key(df["t"]), text.normalized_country(df["t"])).collect()]
    assert got == [(name(n or ""), identity(n or ""), name(n or "").upper()) for n in names]
