"""Inspection of names: each rule on values of its own, and extraction against a search of all token runs."""

import random

import pytest

from meibo.functions import names
from meibo.functions.names import DEFAULT, inspect_name

CASES = {
    None: ("none", None), "": ("none", None), "　": ("none", None), "山田 太郎": ("none", None), "代表取締役 佐藤 花子": ("none", None), "代表取締役社長山田太郎": ("none", None),
    "ご挨拶": ("delete", None), "挨拶 経営理念": ("delete", None), "メッセージ・企業理念": ("delete", None), "【ご挨拶】": ("delete", None), "社長 ご挨拶": ("delete", None), "ＴＯＰ": ("delete", None),
    "各位": ("delete", None), "（代表）": ("delete", None), "名古屋": ("delete", None), "株式会社山田": ("delete", None), "山田工業": ("delete", None), "会社概要": ("delete", None),
    "鈴木 一郎 様": ("update", "鈴木 一郎"), "田中　次郎": ("update", "田中 次郎"), "氏名 山田 太郎": ("update", "山田 太郎"), "職名 理事 氏名 山田 太郎": ("update", "山田 太郎"), "山田太郎 印": ("update", "山田太郎"),
    "山田太郎のプロフィール": ("update", "山田太郎"), "山田太郎 (やまだ)": ("update", "山田太郎"), "山田 太郎 東京大学卒": ("update", "山田 太郎"), "山田 太郎、": ("update", "山田 太郎"),
    "ジョン・スミス": ("none", None), "山田 太郎・鈴木 一郎": ("none", None), "田中 一郎 Tanaka Ichiro": ("none", None), "田中 一郎 たなか いちろう": ("none", None), "四条畷市": ("none", None),
}


@pytest.mark.parametrize("value", CASES)
def test_inspect_name(value):
    assert inspect_name(value)[:2] == CASES[value]


def test_extraction_takes_the_last_tokens_that_make_a_name():
    rng = random.Random(4)
    tokens = ["山田", "太郎", "株式会社", "名古屋", "営業部", "佐藤花子", "ABC", "Taro", "2020", "販売", "様", "代表取締役", "本社", "！？", "高", "北海道"]
    for _ in range(400):
        value = " ".join(rng.choices(tokens, k=rng.randint(1, 5)))
        whole = [t for t in DEFAULT.without_titles(value).split() if DEFAULT.token(t) and DEFAULT.token(t) not in names.NOISE_TOKENS]
        read = [[v for v in (DEFAULT.token(t),) if not DEFAULT.odd_token(v)] for t in whole]  # these tokens stand for nothing but themselves
        runs = [f"{a} {b}" for x, y in zip(read, read[1:], strict=False) for a in x for b in y if DEFAULT.looks_like_name(f"{a} {b}")]
        one = [v for x in read for v in x if DEFAULT.looks_like_name(v)]
        letters = [DEFAULT.token("".join(c for c in t if c.isalpha())) for t in DEFAULT.without_titles(value).split()]  # words and places too, at last
        some = [t for t in letters if DEFAULT.looks_like_name(t)]
        assert DEFAULT.extracted(value) == (runs or one or some or [None])[-1], value


def test_extraction_reads_unspaced_runs_of_letters():
    assert DEFAULT.variants("ABC山田太郎") == ["山田太郎"]
    assert DEFAULT.variants("山田Taro") == ["山田Taro", "山田", "Taro"]
    assert DEFAULT.extracted("販売:山田太郎") == "山田太郎"
    assert DEFAULT.extracted("株式会社 商品") is None


def test_extra_words_and_repeated_names(spark):
    rules = names.Rules(extra_words=(("銘菓 鶴吉羊羹", "exact"), ("羊羹", "content")))
    assert inspect_name("銘菓 鶴吉羊羹", rules)[0] == inspect_name("鶴吉羊羹", rules)[0] == "delete"
    assert inspect_name("鶴吉羊羹")[0] == "none"
    df = spark.createDataFrame([(k, "c", v) for k, v in enumerate(["ご挨拶", "ご挨拶", None, " ", "山田 太郎 様"])], "id long, company string, representative_name string")
    got = {(r.row_id, r.action, r.after_value) for r in names.inspect_names(df, rules=rules).collect()}
    assert got == {(0, "delete", None), (1, "delete", None), (4, "update", "山田 太郎")}
    assert names.inspect_names(df.limit(0)).count() == 0
    read = {r.id: (r.exact, r.stripped) for r in names.read_names(df, "representative_name", ("exact", "stripped")).collect()}
    assert read[0] == (True, "ご挨拶") and read[2] == (None, None) and read[4] == (False, "山田 太郎")
