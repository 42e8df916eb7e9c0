"""Golden vectors of names, specifications, scores and order lines."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import scores, specs, text
from brindle.operators import hotel, tokenizer


def values(spark, f, rows):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, c string").coalesce(1)
    return [r[0] for r in df.select("k", f(F.col("c")).alias("v")).orderBy("k").select("v").collect()]


CASES = [
    (text.clean, {"（去骨）": "(去骨)", "6KG×1条": "6KG*1条", "百瑞  火腿": "百瑞 火腿", "商品***名称": "商品***名称", "a#&b": "a b", "": ""}),
    (text.weight_units, {"6KG": "6000g", "2.5kg": "2500g", "1公斤": "1000g", "5斤": "2500g", "1000克": "1000g", "特精粉2.5kg*3KG/箱": "特精粉2500g*3000g/箱", "2.01kg": "2010.00g"}),
    (text.volume_units, {"500ML": "500mL", "2L": "2L", "5L/瓶": "5000mL/瓶", "3 m³x": "3000000mLx"}),
    (text.length_units, {"30厘米": "30cm", "007毫米": "7mm", "1.5分米": "1.5dm"}),
    (text.gram_variants, {"500G": "500g"}),
    (text.packages, {"20包/箱": "20包 箱", "6瓶/箱": "6瓶 箱", "1000g*12袋": "1000g 12袋"}),
    (text.strip_brand, {"海天牌酱油": "海天酱油", "伊利品牌牛奶": "伊利品牛奶"}),
    (lambda c: text.strip_brand(c, F.lit("金龙鱼")), {"金龙鱼牌大豆油": "大豆油", "好金龙鱼油": "好油", "大豆油": "大豆油"}),
    (text.open_brackets, {"整火腿（去骨）": "整火腿 去骨", "(2023)750ml": "2023 750ml"}),
    (text.weighing_terms, {"散装称重": "散装散称"}),
    (text.normalize_name, {"": "", None: "", "123": "123", "ABC": "ABC"}),
    (specs.extract_spec, {"酱油1000mL/瓶": "1000mL 瓶", "大米 散称": "散称", "茶": ""}),
    (specs.core_name, {"韩国精选辣椒面1000g/袋": "韩国精选辣椒面"}),
    (lambda c: specs.raw_spec(c, F.lit("户户")), {"户户牌韩国精选辣椒面1kg/袋": "1kg 袋"}),
    (specs.leading_brand, {"海天牌酱油": "海天", "扑克牌": "扑克", "酱油": None}),
    (specs.recall_bigrams, {"": [], "盐": ["盐"], "味 极鲜": ["味极", "极鲜"]}),
    (text.bracket_contents, {"a(b)[ c ]()": ["b", "c"]}),
    (text.is_number, {"1.5": True, "x": False, None: False}),
    (text.parse_flag, {"TRUE": True, "false": False, "1": None}),
    (text.json_list, {'["a"]': ["a"], "[x": [], None: []}),
    (text.strip_control, {"a\x01b\n": "ab\n"}),
]


@pytest.mark.parametrize("f,table", CASES)
def test_functions(spark, f, table):
    assert values(spark, f, list(table)) == list(table.values())


def pairs(spark, f, rows):
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(rows)], "k int, a string, b string").coalesce(1)
    return [r[0] for r in df.select("k", f(F.col("a"), F.col("b")).alias("v")).orderBy("k").select("v").collect()]


def test_scores(spark):
    assert pairs(spark, scores.spec_bonus, [("1000mL 瓶", "1000mL*12 瓶"), ("1000mL", "1000g"), ("5g", "6g"), ("", "5g")]) == [0.5, 0.4, -0.1, 0.0]
    assert pairs(spark, scores.spec_confidence, [("5g", "5g"), ("5g", "5mL"), ("5g", "6g"), ("5g", ""), ("散称", "散称"), ("散称", "散称 袋")]) == [1.0, 0.7, 0.5, 0.2, 1.0, 0.5]
    assert pairs(spark, scores.brand_confidence, [("", "x"), ("x", ""), ("x", "xy"), ("x", "y")]) == [0.8, 0.1, 1.0, 0.0]
    assert pairs(spark, scores.name_confidence, [("味极鲜酱油", "味极鲜生抽"), ("盐", "盐"), ("盐", "糖"), ("", ""), ("盐", "食盐")]) == [0.5, 1.0, 0.0, 1.0, 0.0]
    sure = scores.confidence(F.lit("x"), F.lit(""), F.lit("味极鲜酱油"), F.lit("x"), F.lit("5g"), F.lit("味极鲜生抽"))
    assert round(spark.range(1).select(sure).first()[0], 2) == 0.67
    sure = scores.confidence(F.lit("x"), F.lit("5g"), F.lit("味极鲜酱油"), F.lit("y"), F.lit("5g"), F.lit("味极鲜生抽"))
    assert spark.range(1).select(sure).first()[0] == 0.5


def test_tokenizer():
    t = tokenizer.Tokenizer(["百瑞", "大"], ["整火腿", "玉米", "玉米粒", "平底锅", "厘米", "意大利式"])
    assert t("百瑞 意大利式 整火腿 去骨 6000g") == ["百瑞", "意大利式", "整火腿", "去骨", "6000g"]
    assert t("1000g 12袋") == ["1000g", "12袋"]
    assert t("厘米平底锅口") == ["厘米", "平底锅", "口"]
    assert t("金糯玉米粒") == ["金糯", "玉米粒"]
    assert t("30 cm*2 袋") == ["30cm", "2袋"] and t("") == [] and t(None) == []
    assert t("大豆") == ["大豆"] and t("大 豆") == ["大", "豆"]
    assert t("称重") == ["散称"]


def test_attributes(spark):
    assert values(spark, tokenizer.attributes(["转基因", "非转基因", "一级"]), ["福临门牌非转基因一级大豆油8L*2桶/箱", "", None]) == [["非转基因", "一级"], [], []]


def test_core_tokens(spark):
    df = spark.createDataFrame([(["味达美", "味极鲜", "1000mL", "2.5", "6袋", "150", "天", "箱", "散称"], "味达美")], "t array<string>, b string")
    assert df.select(specs.core_tokens(F.col("t"), F.col("b"))).first()[0] == ["味极鲜", "150", "天"]


LINES = {
    "火腿 方 (雨润) 2KG PER PC 员工厨 冰鲜 中国": "火腿 方 (雨润牌) 2KG",
    "小食 香脆椒 (黄飞红) 308GM 干货 中国": "香脆椒 (黄飞红牌) 308GM",
    "小食 原香瓜子 (洽洽) 178GM PER PKT 干货 中国": "原香瓜子 (洽洽牌) 178GM",
    "酱料 酸辣鲜露 (家乐) 468ML 干货 中国": "酸辣鲜露 (家乐牌) 468ML",
    "干果 干柠檬片 干货 中国": "干柠檬片",
}


def test_order_lines(spark):
    full = [f"SNACKS X DR CHN {zh} ({zh})" for zh in LINES]
    assert values(spark, hotel.clean_order_line, full) == list(LINES.values())
    assert values(spark, hotel.clean_order_line, ["ONLY LATIN (X)", "", None]) == ["", "", ""]
    assert values(spark, hotel.is_order_line, [*full, "香脆椒", "SNACKS x (y)"]) == [True] * 5 + [False] * 2
    mode = lambda n: hotel.processing_mode(spark.createDataFrame([(k, full[0] if k < n else "x") for k in range(10)], "item_index int, raw_name string")).first().mode
    assert mode(5) == "special" and mode(4) == "normal"
