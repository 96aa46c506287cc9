"""Facts read from posts, articles and shop pages by ordered rules; all are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyreef.functions.rules import first_match

# Wordings of posts that are of no use, kinds of posts in order, categories, product codes, stores and addresses.
USELESS = r"買取|デッキレシピ|カードリスト|大会(?:結果|情報)?|イベント|プレゼント企画|個人売買|相場|交換希望|譲ります|サプライ|スリーブ|プレイマット|フィギュア|グッズ"
KINDS = (("LOTTERY", r"抽選販売|WEB抽選|店頭抽選|抽選受付|応募受付|購入権|当選"), ("RESERVATION", r"予約受付|予約開始|予約中|受注|店頭受付"), ("RESTOCK", r"再販|再入荷|入荷しました|入荷情報"), ("SALE", r"販売開始|発売開始|販売中|在庫あり"))
CATEGORY_WORDS = (
    ("pokemon", r"(?i)ポケモンカード|ポケカ"), ("onepiece", r"(?i)ONE\s*PIECEカード|ワンピ(?:ース)?(?:カード)?"), ("union_arena", r"(?i)UNION\s*ARENA|ユニオンアリーナ|ユニアリ"),
    ("dragon_ball_fusion_world", r"(?i)ドラゴンボール(?:スーパー)?カードゲーム\s*(?:フュージョンワールド|FW)|DBSCG\s*(?:FUSION\s*WORLD|FW)|DBFW"),
)
CODE = r"(?i)\b((?:SV|M|SM|S|XY|BW)?\d{1,3}[A-Z]?|(?:OP|EB|ST|PRB)-?\d{2,3}|(?:UA|EX)\d{2}(?:BT|ST|DC)|(?:FB|FS|SB|ST)\d{2})\b"
SET_CODE = r"(?i)\b(?:(OP|EB|ST|PRB)\s*[-‐‑‒–—ー]?\s*(\d{2,3})|((?:UA|EX)\d{2}(?:BT|ST|DC)))\b"
STORE = r"(カードラボ[^\s　、。]{0,24}?店|ホビーステーション[^\s　、。]{0,24}?店|ヨドバシ(?:カメラ)?(?:マルチメディア)?[^\s　、。]{0,24}?店|ビックカメラ[^\s　、。]{0,24}?店)"
URL = r"(?i)(https://[^\s<>\]\[()]+)"
PURCHASE = r"(?:購入|受取|引取)(?:可能)?期間?\s*[:：]?\s*([^\n。]{3,80})"

# Rules of the finer classifier of posts, in order; the last two words split a kind.
POST_RULES = (
    ("CANCELLED", r"販売中止|受付中止|予約中止|抽選中止"), ("IRRELEVANT", r"買取|デッキレシピ|カードリスト|大会(?:結果|情報)?|対戦会|相場|キャンペーン|プレゼント企画|個人売買|譲ります|交換希望|フィギュア"),
    ("LOTTERY", r"抽選販売|web抽選|店頭抽選|抽選受付|応募受付|購入権|当選"), ("RESERVATION", r"予約受付|予約開始|予約中|受注|店頭受付"), ("RESTOCK", r"再販|再入荷|入荷しました|入荷情報"), ("SALE", r"販売開始|発売開始|販売中|在庫あり"),
    ("LOTTERY", r"抽選|応募"), ("RESERVATION", r"予約|受付開始|受付中"),
)

# Labels at which the value of another label ends.
LABELS = (
    "応募期間", "抽選期間", "申込期間", "申し込み期間", "予約受付期間", "予約期間", "当選発表", "抽選発表", "結果発表", "当選者店頭販売期間", "当選者購入期間", "当選者店頭予約期間", "購入期間", "予約商品の受取期間",
    "商品お受け取り期間", "受取期間", "引取期間", "発売日", "商品名", "対象商品", "販売価格", "価格",
)

# Conditions of an application: key, wording that states it, wording that hints at it.
CONDITIONS = (
    ("app_required", r"(?:公式|専用)?アプリ(?:から|で|のみ|限定|必須)|アプリ受付", r"アプリ"),
    ("membership_required", r"(?:会員登録|会員資格|会員ID|アカウント)(?:が)?必須|会員限定", r"会員|アカウント|ID"),
    ("credit_card_required", r"クレジットカード(?:登録|決済)?(?:が)?必須|クレカ限定", r"クレジットカード|クレカ"),
    ("store_pickup_only", r"店(?:頭|舗)受取(?:のみ|限定)|受取店舗限定", r"店舗受取|店頭受取"),
    ("identity_verification", r"本人確認(?:書類)?(?:が)?必須|身分証(?:明書)?(?:が)?必要", r"本人確認|身分証"),
    ("purchase_history", r"(?:過去|期間内)の?購入履歴(?:が)?(?:必須|必要)|購入実績(?:が)?必要", r"購入履歴|購入実績"),
    ("region_limited", r"(?:お住まい|居住(?:者|地)?|配送先).{0,12}(?:限定|のみ)|(?:地域|都道府県)限定", r"地域|居住|都道府県"),
    ("age_limit", r"\d{1,2}歳(?:以上|以下|未満)|年齢制限", r"年齢"),
    ("in_store_only", r"店頭(?:での)?(?:受付|応募)(?:のみ|限定)|Web受付なし", r"店頭受付|店頭応募"),
    ("bundle_sale", r"抱き合わせ|対象商品.{0,20}(?:同時購入|セット購入)(?:が)?必須", r"セット販売|同時購入"),
    ("payment_method", r"(?:支払|決済)方法.{0,16}(?:限定|指定)|(?:現金|クレジットカード|代引き)(?:のみ|限定)", r"支払方法|決済方法"),
    ("no_cancellation", r"キャンセル(?:は|が)?(?:不可|できません|お受けできません)", r"キャンセル"),
)
STATED, HINTED = 0.9, 0.55

# Conditions by their words, stock by phrases in order, and words of prices that are not right.
CONDITION_WORDS = (
    ("Xアカウント必須", "Xアカウント未所持|フォロー"), ("リポスト必須", "リポスト"), ("店舗受取限定", "店頭でのお受取|店頭でのみ|店舗へ御来店"), ("本人確認", "身分証明書|本人確認"),
    ("購入数制限", "お一人様"), ("前金・内金", "前金|内金"), ("代理不可", "代理|ご本人様のみ"), ("キャンセル不可", "キャンセル"),
)
STOCK = (("売り切れ", "売り切れ|売切|品切れ"), ("販売終了", "販売終了|受付終了"), ("予約受付中", "予約注文|予約受付|予約商品"), ("販売中", "カートに入れる|販売中|購入する"))
SALE_WORDS = "抽選|予約|販売|応募|受付|発売"


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def post(text: Column, hint: Column) -> Column:
    """Struct of type, category, code, product, url, store and purchase period of a post."""
    t = _or_empty(text)
    kind = first_match([("IRRELEVANT", t.rlike(USELESS)), *[(n, t.rlike(p)) for n, p in KINDS]], "NEWS")
    category = first_match([(n, t.rlike(p)) for n, p in CATEGORY_WORDS], None)
    fusion = t.rlike(r"(?i)\bFW\b") & t.rlike(r"(?i)\b(?:FB|FS|SB)\d{2}\b") & (hint == "other")
    code = F.upper(F.regexp_extract(t, CODE, 1))
    quoted = F.trim(F.regexp_extract(t, "[「『](.{2,100}?)[」』]", 1))
    return F.struct(
        kind.alias("type"), F.coalesce(category, F.when(fusion, "dragon_ball_fusion_world").otherwise(hint)).alias("category"), code.alias("code"), F.when(quoted != "", quoted).otherwise(code).alias("product"),
        F.regexp_replace(F.regexp_extract(t, URL, 1), "[。、]+$", "").alias("url"), F.regexp_extract(t, STORE, 1).alias("store"), F.trim(F.regexp_extract(t, PURCHASE, 1)).alias("purchase"),
    )


def post_kind(text: Column) -> Column:
    """Kind of a post by the finer rules."""
    t = F.lower(F.regexp_replace(_or_empty(text), r"(?U)\s+", " "))
    return first_match([(n, t.rlike(p)) for n, p in POST_RULES], "NEWS")


def filled_by(found: dict[str, Column], supplement: dict[str, Column]) -> dict[str, Column]:
    """What rules found, gaps filled by another reader that may be missing or fail (null)."""
    return {n: F.coalesce(F.nullif(c, F.lit("")), supplement[n], F.lit("")) if n in supplement else c for n, c in found.items()}


def labelled_value(text: Column, labels: Sequence[str]) -> Column:
    """What follows one of the labels, up to the next label of any kind."""
    stop = "|".join(LABELS)
    return F.regexp_replace(F.regexp_extract(text, rf"(?i)(?:{'|'.join(labels)})\s*[：:]\s*(.+?)(?=\s*(?:{stop})\s*[：:]|$)", 1), "^[ 。]+|[ 。]+$", "")


def conditions(text: Column) -> Column:
    """Array of (key, confidence, evidence) in the order of the rules; hints count less than statements."""
    t = F.trim(F.regexp_replace(_or_empty(text), r"(?U)\s+", " "))
    found = []
    for key, strong, weak in CONDITIONS:
        stated, hinted = F.regexp_extract(t, f"(?i)({strong})", 1), F.regexp_extract(t, f"(?i)({weak})", 1)
        found.append(F.when((stated != "") | (hinted != ""), F.struct(F.lit(key).alias("key"), F.when(stated != "", STATED).otherwise(HINTED).alias("confidence"), F.substring(F.when(stated != "", stated).otherwise(hinted), 1, 120).alias("evidence"))))
    return F.array_compact(F.array(*found))


def condition_labels(text: Column) -> Column:
    """Labels of conditions whose words a text holds."""
    return F.array_compact(F.array(*[F.when(_or_empty(text).rlike(words), F.lit(label)) for label, words in CONDITION_WORDS]))


def sentences(text: Column, words: str, most: int = 12) -> Column:
    """Distinct sentences that hold a word, the first ``most``."""
    parts = F.transform(F.split(_or_empty(text), r"[。\n]"), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x.rlike(words))), 1, most)


def stock(text: Column) -> Column:
    """Whether a shop has it, by the first phrase that holds."""
    t = F.regexp_replace(_or_empty(text), r"(?U)\s+", "")
    return first_match([(n, t.rlike(p)) for n, p in STOCK], "状態不明")


def verdict(text: Column, win: Sequence[str], lose: Sequence[str], pending: Sequence[str]) -> Column:
    """Won, lost or pending by the first kind of words that a result page holds."""
    t = _or_empty(text)
    return first_match([("当選候補", t.rlike("|".join(win))), ("落選候補", t.rlike("|".join(lose))), ("結果待ち候補", t.rlike("|".join(pending)))], "判定できません")


def name_words(name: Column, most: int = 6) -> Column:
    """The first words of three characters or more of a name, without words for packs."""
    clean = F.regexp_replace(_or_empty(name), "強化拡張パック|拡張パック|ハイクラスパック|スターターセットex|スターターセット|構築デッキ", " ")
    return F.transform(F.slice(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9一-龠ぁ-んァ-ヶー]{3,}"), F.lit(0)), 1, most), lambda x: F.lower(x))


def search_terms(*terms: Column) -> Column:
    """Distinct terms that are filled, in order."""
    return F.array_distinct(F.filter(F.array(*[F.trim(_or_empty(t)) for t in terms]), lambda x: x != ""))


def set_code(*values: Column) -> Column:
    """Code of a set in one spelling; empty if there is none."""
    t = F.concat_ws(" ", *values)
    letters, digits, other = (F.regexp_extract(t, SET_CODE, i) for i in (1, 2, 3))
    return F.when(other != "", F.upper(other)).when(letters != "", F.concat(F.upper(letters), F.lit("-"), digits)).otherwise("")


def terms_match(code: Column, text_code: Column, terms: Column, text: Column) -> Column:
    """A code decides where there is one; else two of the terms, or all if fewer, stand in the text."""
    held = F.size(F.filter(terms, lambda x: F.contains(text, x)))
    return F.when(code != "", code == text_code).otherwise((F.size(terms) > 0) & (held >= F.least(F.lit(2), F.size(terms))))


def text_confidence(text: Column, words: Column, release: Column) -> Column:
    """Share of keywords by .65, a sales word .20, and the release date in one of three notations .15; at most 1."""
    t = _or_empty(text)
    flat = F.lower(F.regexp_replace(t, r"(?U)[\s「」『』・･_\-&＆（）()【】\[\]、。！!：:]", ""))
    share = F.try_divide(F.size(F.filter(words, lambda w: F.contains(flat, w))).cast("double"), F.size(words))
    japanese = F.replace(F.regexp_replace(release, r"^(\d{4})-(\d{2})-(\d{2})$", "$1年$2月$3日"), F.lit("月0"), F.lit("月"))
    dated = F.contains(flat, F.replace(release, F.lit("-"), F.lit(""))) | F.contains(t, F.replace(release, F.lit("-"), F.lit("/"))) | F.contains(t, japanese)
    score = share * 0.65 + F.when(t.rlike(SALE_WORDS), 0.20).otherwise(0.0) + F.when((release != "") & dated, 0.15).otherwise(0.0)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def match_confidence(codes: tuple[Column, Column], names: tuple[Column, Column], tokens: tuple[Column, Column], dates: tuple[Column, Column]) -> Column:
    """Codes decide; else equal names, one name in the other, or shared words, with a bonus for equal dates and a veto for others."""
    a, b = names
    la, lb = F.length(a), F.length(b)
    shared = F.size(F.array_intersect(*tokens))
    by_words = F.when(F.size(tokens[0]) == 0, 0.0).otherwise(0.65 * shared / F.greatest(F.size(tokens[0]), F.lit(1)) + 0.25 * shared / F.greatest(F.size(tokens[1]), F.lit(1)))
    base = F.when((a == "") | (b == ""), 0.0).when(a == b, 0.95).when(F.contains(a, b) | F.contains(b, a), 0.84 + 0.10 * F.least(la, lb) / F.greatest(la, lb)).otherwise(by_words)
    dated = (dates[0] != "") & (dates[1] != "")
    return F.when((codes[0] != "") & (codes[1] != ""), F.when(codes[0] == codes[1], 1.0).otherwise(0.0)).when(dated & (dates[0] != dates[1]), 0.0).otherwise(F.least(F.lit(0.99), base + F.when(dated, 0.08).otherwise(0.0)))


def highest_price(text: Column, low: int = 100, high: int = 1_000_000) -> Column:
    """The highest yen amount within bounds; null if none."""
    found = F.regexp_extract_all(_or_empty(text), F.lit(r"([\d,]+)\s*円"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("long")), lambda n: n.between(low, high)))


def first_price(text: Column) -> Column:
    """The first yen amount; null if none or not above zero."""
    n = F.regexp_replace(F.regexp_extract(_or_empty(text), r"([\d,]+)\s*円", 1), ",", "").try_cast("long")
    return F.when(n > 0, n)


def json_ld(html: Column) -> Column:
    """Texts of the JSON-LD blocks of a page."""
    return F.regexp_extract_all(_or_empty(html), F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def json_ld_products(html: Column) -> Column:
    """(name, url) of the products that JSON-LD blocks name: at the top, in a list, in a graph, or as items of a list."""
    node = "struct<`@type`:string,name:string,url:string,`@graph`:array<struct<`@type`:string,name:string,url:string>>,itemListElement:array<struct<`@type`:string,name:string,url:string,item:struct<`@type`:string,name:string,url:string>>>>"

    def of(text: Column) -> Column:
        listed = F.when(F.trim(text).startswith("["), F.from_json(text, f"array<{node}>")).otherwise(F.array(F.from_json(text, node)))
        own = lambda x: F.struct(x["@type"].alias("type"), x["name"].alias("name"), x["url"].alias("url"))
        empty = F.array().cast("array<struct<type:string,name:string,url:string>>")
        below = lambda x: F.concat(F.array(own(x)), F.coalesce(F.transform(x["@graph"], own), empty), F.coalesce(F.transform(x["itemListElement"], own), empty), F.coalesce(F.transform(x["itemListElement"], lambda y: own(y["item"])), empty))
        return F.flatten(F.transform(F.filter(F.coalesce(listed, F.array().cast(f"array<{node}>")), lambda x: x.isNotNull()), below))

    found = F.flatten(F.transform(json_ld(html), of))
    return F.transform(F.filter(found, lambda x: ((x["type"] == "Product") | x["type"].contains('"Product"')) & (F.trim(_or_empty(x["name"])) != "")), lambda x: F.struct(F.trim(x["name"]).alias("name"), x["url"].alias("url")))
