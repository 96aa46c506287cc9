"""Stored rows made fit for use: accounts, sites, evidence, products as the catalog shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreef.functions import names, periods
from tallyreef.functions.text import blank, first_filled
from tallyreef.functions.urls import application_url

# Kinds of accounts by their older names, kinds with their usual trust, and categories that are watched.
OLDER_KINDS = {"manufacturer_official": "OFFICIAL_MANUFACTURER", "official_store": "OFFICIAL_STORE", "store_official": "OFFICIAL_SHOP_BRANCH", "trusted_information": "TRUSTED_INFORMATION", "general_information": "GENERAL_INFORMATION"}
USUAL_TRUST = {"OFFICIAL_MANUFACTURER": "OFFICIAL_TCG", "OFFICIAL_STORE": "OFFICIAL_STORE", "OFFICIAL_SHOP_BRANCH": "TRUSTED_STORE", "TRUSTED_INFORMATION": "INFO_ACCOUNT", "GENERAL_INFORMATION": "INFO_ACCOUNT"}
TRUST_LEVELS = ("OFFICIAL_TCG", "OFFICIAL_STORE", "TRUSTED_CHAIN", "TRUSTED_STORE", "INFO_ACCOUNT")
WATCHED = ("pokemon", "onepiece", "union_arena", "dragon_ball_fusion_world")
USUAL_SCORE = 30

# Ways of selling by other names, and wordings that tell them.
MODES = {"PHYSICAL": "STORE", "CHAIN": "STORE", "WEB": "ONLINE", "EC": "ONLINE"}
ONLINE_WORDS = r"(?i)(?:web|online|オンライン|ネット(?:応募|抽選|受付|販売)|ウェブ|応募フォーム|公式アプリ|アプリ受付|通販|(?:^|[^a-z])ec(?:[^a-z]|$))"
STORE_WORDS = r"(?i)(?:店頭|店舗(?:受付|抽選|販売|購入|受取)|受取店舗|店舗へ来店|店舗にて|店頭で|Loppi)"
ONLINE_HOSTS = ("pokemoncenter-online", "p-bandai.jp", "premium-bandai")

# What makes a stored row a product or an application.
PRODUCT_WORDS = r"(?i)(?:BOX|パック|デッキ|カードセット|プレミアムセット|スターター|構築済み)"
APPLICATION_TITLE = r"(?:抽選|応募|予約|入荷|再入荷|販売)(?:受付|開始|案内|情報|について|のお知らせ|中止|終了|予定|商品)*"
APPLICATION_RECORDS = ("APPLICATION", "APPLICATION_CANDIDATE", "APPLICATION_CONFIRMED")
APPLICATION_SOURCES = ("retail_search", "application", "application_candidate", "trusted_store_x", "official_x")


def _mapped(value: Column, known: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), value)


def accounts(df: DataFrame) -> DataFrame:
    """username, tcg, source_type, score and trust_level of rows (username, tcg, source_type, category, score, trust_level) that are valid."""
    name = F.regexp_replace(blank(F.col("username")), "^@+", "")
    kind = F.coalesce(F.nullif(F.upper(blank(F.col("source_type"))), F.lit("")), _mapped(F.lower(blank(F.col("category"))), OLDER_KINDS), F.lit("GENERAL_INFORMATION"))
    trust = F.upper(blank(F.col("trust_level")))
    score = F.when(F.col("score").isNull(), USUAL_SCORE).otherwise(F.col("score").try_cast("int"))
    out = df.select(name.alias("username"), F.lower(blank(F.col("tcg"))).alias("tcg"), kind.alias("source_type"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"), score.isNotNull().alias("scored"), trust.alias("trust"))
    out = out.filter(F.col("username").rlike("^[A-Za-z0-9_]{1,15}$") & F.col("tcg").isin(*WATCHED) & F.col("source_type").isin(*USUAL_TRUST) & F.col("scored"))
    return out.select("username", "tcg", "source_type", "score", F.when(F.col("trust").isin(*TRUST_LEVELS), F.col("trust")).otherwise(_mapped(F.col("source_type"), USUAL_TRUST)).alias("trust_level"))


def sales_mode(told: list[Column], texts: list[Column], url: Column, branch_of_store: Column) -> Column:
    """A way of selling that is told, else the ones that the texts show."""
    chain = F
    for value in told:
        upper = F.upper(blank(value))
        known = F.coalesce(_mapped(upper, MODES), upper)
        chain = chain.when(known.isin("ONLINE", "STORE", "HYBRID"), known)
    text = names.nfkc(F.concat_ws(" ", *texts))
    online = text.rlike(ONLINE_WORDS) | F.coalesce(F.lower(url), F.lit("")).rlike("|".join(x.replace(".", "[.]") for x in ONLINE_HOSTS))
    store = text.rlike(STORE_WORDS) | F.coalesce(branch_of_store, F.lit(False))
    return chain.otherwise(F.when(online & store, "HYBRID").when(online, "ONLINE").when(store, "STORE").otherwise("UNKNOWN"))


def repeats_other_url(application: Column, *others: Column) -> Column:
    """The application's address is, in canonical form, one of the row's other addresses."""
    own = application_url(application)
    same = F.lit(False)
    for other in others:
        same = same | (own == application_url(other))
    return (own != "") & same


def application_evidence(url: Column, repeated: Column, filled: list[Column], method: Column, statuses: list[Column]) -> Column:
    """There is an application and no mere listing: an address of its own, a filled period or result, a way to apply, or a status that says so."""
    said = F.lit(False)
    for s in statuses:
        said = said | blank(s).rlike("受付|応募|抽選|予約")
    some = F.lit(False)
    for c in filled:
        some = some | (blank(c) != "")
    return ((blank(url) != "") & ~repeated) | some | blank(method).rlike("応募|申込|申し込み|抽選|予約|受付") | said


def is_product(information_type: Column, ids: list[Column], name: Column, kind: Column, source_type: Column) -> Column:
    """The catalog shows the row: no application, and an identifier, a product's wording, or at least no application's title."""
    has_id = F.lit(False)
    for c in ids:
        has_id = has_id | (blank(c) != "")
    worded = blank(name).rlike(PRODUCT_WORDS) | blank(kind).rlike(PRODUCT_WORDS)
    titled = F.lower(blank(source_type)).isin(*APPLICATION_SOURCES) & blank(name).rlike(APPLICATION_TITLE)
    return ~F.upper(blank(information_type)).isin(*APPLICATION_RECORDS) & (has_id | worded | ~titled)


def evidence(source_type: Column, url: Column, trust: Column, observed: Column) -> Column:
    """A piece of evidence as it is kept: its kind in capitals, trust within 0 and 100."""
    kind = F.upper(F.coalesce(F.nullif(F.trim(source_type), F.lit("")), F.lit("GENERAL_INFORMATION")))
    return F.struct(kind.alias("source_type"), blank(url).alias("source_url"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(trust.try_cast("int"), F.lit(USUAL_SCORE)))).alias("trust"), blank(observed).alias("observed_at"))


def distinct_evidence(df: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """The first piece of evidence of each kind and address."""
    first = df.groupBy(*keys, F.col(f"{item}.source_type").alias("source_type"), F.col(f"{item}.source_url").alias("source_url")).agg(F.min_by(F.struct(item, order), order).alias("x"))
    return first.select(*keys, f"x.{order}", F.col(f"x.{item}.*"))


def identity(df_id: Column, product: Column, chain: Column, branch: Column, end: Column, url: Column, category: Column) -> Column:
    """An application's explicit id, else category, product, chain, branch, end and canonical address."""
    parts = F.concat_ws("|", periods.blank_or(category, "other"), F.lower(blank(product)), F.lower(blank(chain)), F.lower(blank(branch)), blank(end), application_url(url))
    return first_filled(df_id, parts)


def matching_period(end: Column, now: Column) -> Column:
    """A record or hit whose period is over."""
    return F.coalesce(now > end, F.lit(False))
