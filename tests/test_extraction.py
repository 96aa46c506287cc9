"""Facts that texts tell, case by case."""

from pyspark.sql import functions as F

from tallyreef.functions import extract, pages

#: Posts with type, category, code, product, url, store, purchase period, and kind by the finer rules.
_POSTS = (
    ("ポケモンカード「スカーレット」抽選販売 https://a.example/x。", "LOTTERY", "pokemon", "", "スカーレット", "https://a.example/x", "", "", "LOTTERY"),
    ("ワンピースカード OP-12 予約開始 カードラボ秋葉原店", "RESERVATION", "onepiece", "OP-12", "OP-12", "", "カードラボ秋葉原店", "", "RESERVATION"),
    ("FW FB05 再入荷 購入期間：7月20日まで", "RESTOCK", "dragon_ball_fusion_world", "FB05", "FB05", "", "", "7月20日まで", "RESTOCK"),
    ("ポケカ 買取 強化中", "IRRELEVANT", "pokemon", "", "", "", "", "", "IRRELEVANT"),
    ("ユニアリ 販売中", "SALE", "union_arena", "", "", "", "", "", "SALE"),
    ("お知らせ", "NEWS", "other", "", "", "", "", "", "NEWS"),
    ("抽選のお知らせ 受付中止", "NEWS", "other", "", "", "", "", "", "CANCELLED"),
    ("応募 受付中", "NEWS", "other", "", "", "", "", "", "LOTTERY"),
    (None, "NEWS", "other", "", "", "", "", "", "NEWS"),
)
#: Articles with the values of two labels, condition labels, stock, and the highest and first price.
_ARTICLES = (
    ("商品名：新パック 応募期間：7月1日～7月5日 当選発表：7月9日。", "7月1日～7月5日", "新パック", "", "状態不明", None, None),
    ("価格：5,400円（税込） 応募期間: 未定 購入する", "未定 購入する", "", "", "販売中", 5400, 5400),
    ("お一人様1点。キャンセル不可。予約受付 99円 12,000円 2,000,000円", "", "", "購入数制限,キャンセル不可", "予約受付中", 12000, 99),
    ("売り 切れ フォロー＆リポスト 本人確認", "", "", "Xアカウント必須,リポスト必須,本人確認", "売り切れ", None, None),
    ("販売終了 代理 前金 0円", "", "", "前金・内金,代理不可", "販売終了", None, None),
    ("", "", "", "", "状態不明", None, None),
)
#: Notices with the conditions that they state or hint at, and sentences that hold a word.
_NOTICES = (
    ("公式アプリから応募。会員 登録が必要", "app_required=0.9,membership_required=0.55", "公式アプリから応募"), ("クレジットカード決済が必須です\n18歳以上", "credit_card_required=0.9,age_limit=0.9", ""),
    ("店舗受取限定。店頭受付のみ", "store_pickup_only=0.9,in_store_only=0.9", ""), ("身分証が必要、本人確認。応募は一度。応募は一度", "identity_verification=0.9", "応募は一度"),
    ("購入履歴と地域、年齢", "purchase_history=0.55,region_limited=0.55,age_limit=0.55", ""), ("お住まいの県のみ。抱き合わせ 支払方法", "region_limited=0.9,bundle_sale=0.9,payment_method=0.55", ""),
    ("キャンセルできません 代引きのみ", "payment_method=0.9,no_cancellation=0.9", ""), ("", "", ""),
)
_RESULTS = (("おめでとうございます 当選", "当選候補"), ("残念ながら落選", "落選候補"), ("結果発表をお待ちください", "結果待ち候補"), ("案内", "判定できません"), ("落選 当選", "当選候補"))
_NAMES = (("ポケモン 強化拡張パック ABCdef 新時代 x1", "ポケモン,abcdef,新時代"), ("構築デッキ", ""), ("aaa bbb ccc ddd eee fff ggg", "aaa,bbb,ccc,ddd,eee,fff"), ("", ""))
_CODES = (("op 12", "OP-12"), ("EB‐03 x", "EB-03"), ("ua12bt", "UA12BT"), ("none", ""), ("prb-101", "PRB-101"))

_CLASSES = (
    ("高価買取", "抽選 応募期間", "pokemon", "excluded"), ("大会のお知らせ", "抽選販売なし 対象商品", "pokemon", "lottery"), ("大会", "お知らせ", "pokemon", "event"), ("新弾", "抽選 当選発表 再販", "pokemon", "resale"), ("新弾", "予約受付 予約期間", "pokemon", "reservation"),
    ("移転", "営業時間", "unknown", "general_news"), ("新弾", "発売日 税込", "unknown", "excluded"), ("再販売", "新品", "pokemon", "resale"), ("新弾", "通常販売 税込", "pokemon", "regular_sale"), ("新弾", "発売日 商品名", "pokemon", "product_info"),
    ("新弾", "エントリー", "pokemon", "event"), ("入荷", "", "pokemon", "general_news"), ("x", "y", "pokemon", "needs_review"),
)
_SEGMENTS = (("応募受付期間：2026年7月1日 10:00 ～ 2026年7月9日 当選発表 2026年8月1日", "2026-07-01 10:00:00", "2026-07-09 00:00:00"), ("受付期間:～2026年7月5日(日) 23:59", None, "2026-07-05 23:59:00"), ("受付期間：2026年2月30日 2026年3月1日", "2026-03-01 00:00:00", None), ("期間 2026年7月1日", None, None))


def told(spark, cases, *columns):
    """The values of some columns of a text t, case by case."""
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_posts(spark):
    x = extract.post(F.col("t"), F.lit("other"))
    assert told(spark, _POSTS, *[x[n] for n in ("type", "category", "code", "product", "url", "store", "purchase")], extract.post_kind(F.col("t"))) == [c[1:] for c in _POSTS]


def test_articles(spark):
    t = F.col("t")
    found = told(spark, _ARTICLES, extract.labelled_value(t, ("応募期間", "抽選期間")), extract.labelled_value(t, ("商品名",)), F.array_join(extract.condition_labels(t), ","), extract.stock(t), extract.highest_price(t), extract.first_price(t))
    assert found == [c[1:] for c in _ARTICLES]


def test_notices(spark):
    t = F.col("t")
    kinds = F.transform(extract.conditions(t), lambda x: F.concat_ws("=", x["key"], x["confidence"].cast("string")))
    assert told(spark, _NOTICES, F.array_join(kinds, ","), F.array_join(extract.sentences(t, "応募"), "|")) == [c[1:] for c in _NOTICES]


def test_results_names_and_codes(spark):
    t = F.col("t")
    assert told(spark, _RESULTS, extract.verdict(t, ["当選"], ["落選"], ["結果発表"])) == [c[1:] for c in _RESULTS]
    assert told(spark, _NAMES, F.array_join(extract.name_words(t), ",")) == [c[1:] for c in _NAMES]
    assert told(spark, _CODES, extract.set_code(t)) == [c[1:] for c in _CODES]


def test_classes_and_segments(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(_CLASSES)], "i int, title string, body string, category string")
    assert [r.x for r in df.select("i", pages.article_class(*map(F.col, ("title", "body", "category"))).alias("x")).orderBy("i").collect()] == [c[3] for c in _CLASSES]
    span = pages.segment_period(F.col("t"))
    assert told(spark, _SEGMENTS, span["start"].cast("string"), span["end"].cast("string")) == [c[1:] for c in _SEGMENTS]
