"""Prices and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAX = 1.10


def price(value: Column, tax_included: Column | bool = True) -> Column:
    """First whole number of a value with thousands commas; none or zero is null; tax is added half-even."""
    amount = F.regexp_replace(F.regexp_extract(value.cast("string"), r"(\d[\d,]*)", 1), ",", "").try_cast("long")
    amount = F.when(amount > 0, amount)
    included = tax_included if isinstance(tax_included, Column) else F.lit(tax_included)
    return F.when(included, amount).otherwise(F.bround(amount * TAX).cast("long"))


def reference_price(*columns: Column) -> Column:
    """The first of some fields that holds a price."""
    return F.coalesce(*[price(c) for c in columns])


def sale_price(*columns: Column) -> Column:
    """The price of the first field that is present, even if that holds none."""
    chain = F.lit(None).cast("long")
    for c in reversed(columns):
        chain = F.when(c.isNotNull(), price(c)).otherwise(chain)
    return chain


def amounts(text: Column, low: int = 100, high: int = 1_000_000) -> Column:
    """Yen amounts of a text within bounds."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*)\s*(?:円|yen)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda n: n.between(low, high))


def price_verdict(text: Column, verified: Column, reference: Column, sale: Column, tolerance: Column, exclusions: dict[str, str]) -> Column:
    """The first reason to refuse an offer, else accepted; reasons in order: wording, seller, price."""
    chain = None
    for reason, pattern in exclusions.items():
        found = F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")
        chain = F.when(found, reason) if chain is None else chain.when(found, reason)
    seller = ~F.coalesce(verified, F.lit(False))
    dear = reference.isNotNull() & sale.isNotNull() & (sale > F.bround(reference * tolerance))
    chain = F.when(seller, "seller") if chain is None else chain.when(seller, "seller")
    return chain.when(dear, "price").otherwise("accepted")


def bounded(value: Column) -> Column:
    """A number clamped to 0..1; what is none counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def confidence(trust: Column, evidence: Column, official: Column, has_url: Column, dates_agree: Column, product: Column, store: Column) -> Column:
    """Weighted score of a discovery, at most 1, to four places half-even."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    score = trust / 100 * 0.35 + F.least(evidence, F.lit(3)) / 3 * 0.15 + flag(official) * 0.20 + flag(has_url) * 0.10 + flag(dates_agree) * 0.05 + bounded(product) * 0.075 + bounded(store) * 0.075
    return F.bround(F.least(F.lit(1.0), score), 4)


def verdict(agree: Column, expired: Column, official: Column, explicit_type: Column, score: Column, least: float = 0.75) -> Column:
    """REJECTED on contradiction, CONFIRMED on official current evidence, else CANDIDATE."""
    return F.when(~agree, "REJECTED").when(~expired & official & explicit_type & (score >= least), "CONFIRMED").otherwise("CANDIDATE")


def accuracy(confirmed: Column, rejected: Column) -> Column:
    """Confirmed share of what is decided; null if nothing is."""
    return F.bround(F.try_divide(confirmed.cast("double"), (confirmed + rejected).cast("double")), 4)


# Wordings that exclude an offer, in order, and how far above its price a kind may be sold.
EXCLUSIONS = (
    ("中古品", r"中古|ユーズド|開封済み|開封品"),
    ("オリパ", r"オリパ|オリジナルパック"),
    ("まとめ売り", r"まとめ売り|大量セット|引退品"),
    ("抱き合わせ販売", r"抱き合わせ|セット販売|\d+\s*(?:個|箱|BOX)セット"),
    ("オークション・フリマ", r"入札|オークション|フリマ|メルカリ|ヤフオク"),
    ("海外版", r"海外版|英語版|北米版|EU版|アジア版|並行輸入"),
    ("プレミア価格表記", r"プレミア価格|希少価格|相場価格"),
    ("販売終了・在庫切れ", r"在庫切れ|販売終了|受付終了|売り切れ"),
)
TOLERANCE = {
    "ブースターパック": 1.15, "エクストラブースター": 1.15, "スタートデッキ": 1.20, "スターターデッキ": 1.20, "構築デッキ": 1.20, "プレミアムカードコレクション": 1.10, "プレミアム商品": 1.10, "アクセサリー": 1.25, "その他": 1.15,
}
# Shops with many sellers, and the sellers that are the shop itself.
AMAZON, MALLS, BOOKS = "amazon_jp", ("yahoo_shopping", "rakuten_marketplace", "dmm_marketplace"), "rakuten_books"
AMAZON_SELLERS, BOOKS_SELLER = ("amazon.co.jp", "amazon japan g.k."), "楽天ブックス"


def offer_verdict(text: Column, shop: Column, seller: Column, shipper: Column, verified: Column, official: Column, kind: Column, reference: Column, sale: Column) -> Column:
    """The first reason to refuse an offer, else accepted: wording, who sells it, price."""
    known = F.coalesce(text, F.lit(""))
    chain = F
    for reason, pattern in EXCLUSIONS:
        chain = chain.when(known.rlike(f"(?i){pattern}"), reason)
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = F.lower(F.trim(F.coalesce(seller, F.lit("")))).isin(*AMAZON_SELLERS) & F.lower(F.trim(F.coalesce(shipper, F.lit("")))).isin(*AMAZON_SELLERS)
    by = F.trim(F.coalesce(seller, F.lit("")))
    chain = chain.when((shop == AMAZON) & ~own, "marketplace").when(shop.isin(*MALLS) & ~(yes(verified) & yes(official)), "mall")
    chain = chain.when((shop == BOOKS) & (by != "") & ~by.contains(BOOKS_SELLER), "third party").when(~shop.isin(AMAZON, *MALLS, BOOKS) & ~yes(verified), "unverified")
    limits = F.create_map(*[F.lit(x) for pair in TOLERANCE.items() for x in pair])
    limit = F.coalesce(F.try_element_at(limits, kind), F.lit(TOLERANCE["その他"]))
    return chain.when(F.coalesce(sale > F.bround(reference * limit), F.lit(False)), "price").otherwise("accepted")
