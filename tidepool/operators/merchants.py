"""Receipts verified: who sent them, whose they are, what they say and what kind of purchase they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool import text as T
from tidepool.registry import query
from tidepool.sources.tables import micros, table

DAY = 86_400_000_000
# Providers that no receipt comes from.
CONSUMER = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com icloud.com me.com mac.com proton.me protonmail.com gmx.com mail.com zoho.com yandex.com".split()
# Brands that others claim to be.
BRANDS = ["paypal", "geeksquad", "geek squad", "bestbuy", "best buy", "norton", "mcafee", "amazon", "apple", "microsoft", "coinbase", "venmo", "docusign", "fedex", "ups", "dhl", "netflix", "paypa1"]
# Platforms that send for any merchant.
PLATFORMS = """shopifyemail.com sendgrid.net mailgun.org mailgun.net klaviyomail.com mcsv.net rsgsv.net mailchimpapp.net sparkpostmail.com amazonses.com postmarkapp.com mandrillapp.com sendinblue.com brevo.com
cmail19.com createsend.com hubspotemail.net salesforce.com exacttarget.com mktomail.com incentivio.com ordermillinc.com toasttab.com squareup.com""".split()
# Fixed value: words of money that comes back.
REFUND = r"(?i)\b(refund(ed|s)?|credit(ed)? back|reversal|reversed|money back|return(ed)? to your)\b"
#: Amounts from here on need more than a platform's word, in cents.
LARGE = 15_000


def sender_domain(author: Column) -> Column:
    address = F.lower(F.trim(F.when(author.rlike("<[^<>]+>"), F.regexp_extract(author, "<([^<>]+)>", 1)).otherwise(author)))
    return F.coalesce(F.get(F.split(address, "@"), F.lit(1)), F.lit(""))


def trust_sender(author: Column) -> Column:
    """PUR-2: why a receipt's sender is not to be trusted; null if it is."""
    domain = sender_domain(author)
    display = F.regexp_replace(F.lower(F.trim(F.regexp_extract(author, "^([^<]+)<", 1))), "^[\"']|[\"']$", "")
    brands = F.array(*(F.lit(b) for b in BRANDS))
    # The first brand that the name claims decides.
    claimed = F.get(F.filter(brands, lambda b: F.contains(display, b)), F.lit(0))
    return (
        F.when(author.isNull() | (F.trim(author) == ""), "no sender")
        .when(domain == "", "no sending domain")
        .when(domain.isin(*CONSUMER), "consumer domain")
        .when(claimed.isNotNull() & ~F.contains(domain, F.replace(claimed, F.lit(" "), F.lit(""))), "claims a brand")
    )


def shared_sender(author: Column) -> Column:
    """PUR-7: whether the domain is a platform's, which says nothing about the merchant."""
    domain = sender_domain(author)
    return F.coalesce(F.exists(F.array(*(F.lit(p) for p in PLATFORMS)), lambda p: (domain == p) | F.endswith(domain, F.concat(F.lit("."), p))), F.lit(False))


#: Fixed value: characters a key has at least to stand for a longer one.
LEAST_ALIKE = 12


def clean_merchant(name: Column) -> Column:
    """PUR-7: a merchant's name without footers and cut marks; null if what is left is no name."""
    head = F.trim(F.when(F.contains(name, F.lit("@")), F.substring_index(F.trim(name), "@", 1)).otherwise(name))
    for pattern in (r"(?i)\ball rights reser?v?e?d?\b\.?", "(?i)\\bcopyright\\b|©", r"\.{2,}$", r"[\s,;|-]+$"):
        head = F.regexp_replace(head, T.java(pattern), "")
    clean = F.trim(head)
    return F.when(F.char_length(clean).between(2, 60) & ~clean.rlike("[$£€]\\s?[0-9]"), clean)


def looks_like_refund(text: Column) -> Column:
    return text.rlike(T.java(REFUND))


def is_transfer(merchant: Column) -> Column:
    """PUR-6: whether a merchant only moves money."""
    key = T.merchant_key(merchant)
    return F.coalesce(F.exists(F.array(*(F.lit(m) for m in T.TRANSFERS)), lambda m: F.startswith(key, m)), F.lit(False))


def same_merchant(a: Column, b: Column) -> Column:
    """PUR-4: equal keys, or one of twelve characters or more that the other continues by three at most."""
    left, right = T.merchant_key(a), T.merchant_key(b)
    short, long = F.when(F.char_length(left) <= F.char_length(right), left).otherwise(right), F.when(F.char_length(left) <= F.char_length(right), right).otherwise(left)
    return (left == right) | ((F.char_length(short) >= 12) & F.startswith(long, short) & (F.char_length(long) - F.char_length(short) <= 3))


def display_merchant(name: str) -> Column:
    """PUR-5: of a group's names the longest, then that of most small letters, then the first."""
    small = F.char_length(F.regexp_replace(name, "[^a-z]", ""))
    return F.min_by(name, F.struct(-F.char_length(name), -small, F.col(name)))


def purchase_date(stated: Column, arrived: Column) -> Column:
    """PUR-9: the stated date unless it is far from the receipt's arrival."""
    return F.when(stated.between(arrived - 30 * DAY, arrived + 2 * DAY), stated).otherwise(arrived)


def rejected(cents: Column, priced: Column, merchant: Column, text: Column) -> Column:
    """PUR-8: why an extracted purchase is not believed; null if it is.

    ``priced``: the lines' cents.  The total's digits have to stand in the text,
    and several lines have to add up to something like it.
    """
    digits = F.regexp_replace(text, "[^0-9]", "")
    total = F.aggregate(priced, F.lit(0).cast("long"), lambda s, x: s + x)
    return (
        F.when(cents <= 0, "no total")
        .when(~F.contains(digits, cents.cast("string")), "total not in the text")
        .when((F.size(priced) > 1) & ~total.between(F.floor(cents * 0.4), F.ceil(cents * 1.5)), "lines do not add up")
        .when(clean_merchant(merchant).isNull(), "no merchant")
        .when(looks_like_refund(text), "refund")
    )


def purchase_type(merchant: Column, cents: Column, author: Column, corroborated: Column) -> Column:
    """PUR-10: transfer, unconfirmed (a large sum by a platform's word alone) or purchase."""
    return typed_by(merchant, cents >= LARGE, author, corroborated)


def typed_by(merchant: Column, large: Column, author: Column, corroborated: Column) -> Column:
    """PUR-10 of any sum that is large or not."""
    return F.when(is_transfer(merchant), "transfer").when(large & shared_sender(author) & ~corroborated, "unconfirmed").otherwise("purchase")


# --- suppliers as senders, orders as receipts ------------------------------------------


def _senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, merchant, author): suppliers, some of which write as brands or through platforms."""
    key = F.col("s_suppkey")
    brand = F.element_at(F.array(*(F.lit(b) for b in BRANDS)), (key % len(BRANDS) + 1).cast("int"))
    platform = F.element_at(F.array(*(F.lit(p) for p in PLATFORMS)), (key % len(PLATFORMS) + 1).cast("int"))
    merchant = F.when(key % 7 == 0, F.concat(F.initcap(brand), F.lit(", Inc. All Rights Reserved"))).when(key % 7 == 1, F.lit("Venmo Payments LLC")).otherwise(F.concat(F.col("s_name"), F.lit(" Store")))
    domain = F.when(key % 5 == 0, "gmail.com").when(key % 5 == 1, F.concat(F.lit("t."), platform)).when(key % 5 == 2, F.concat(F.replace(brand, F.lit(" "), F.lit("")), F.lit(".com"))).otherwise("shop.example.org")
    return table(spark, sf_dir, "supplier").select("s_suppkey", merchant.alias("merchant"), F.when(key % 11 == 10, F.lit(None)).otherwise(F.concat(F.lit('"'), merchant, F.lit('" <orders@'), domain, F.lit(">"))).alias("author"))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SENDERS = f"""br AS (SELECT s_suppkey AS k, s_name, {_list_sql(BRANDS)}[(s_suppkey % {len(BRANDS)} + 1)::INTEGER] AS brand, {_list_sql(PLATFORMS)}[(s_suppkey % {len(PLATFORMS)} + 1)::INTEGER] AS platform FROM supplier),
me AS (SELECT *, CASE WHEN k % 7 = 0 THEN array_to_string(list_transform(string_split(brand, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ', Inc. All Rights Reserved' WHEN k % 7 = 1 THEN 'Venmo Payments LLC' ELSE s_name || ' Store' END AS merchant,
  CASE WHEN k % 5 = 0 THEN 'gmail.com' WHEN k % 5 = 1 THEN 't.' || platform WHEN k % 5 = 2 THEN replace(brand, ' ', '') || '.com' ELSE 'shop.example.org' END AS domain FROM br),
senders AS (SELECT k AS s_suppkey, merchant, domain, CASE WHEN k % 11 <> 10 THEN '"' || merchant || '" <orders@' || domain || '>' END AS author FROM me)"""
_KEY = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(merchant)), '\\s*[.,-]\\s*$', ''), '^(the|a)\\s+', ''), {T.sql(T.COMPANY)}, '', 'g'), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {_SENDERS}, c AS (SELECT *, list_filter({_list_sql(BRANDS)}, lambda b: contains(lower(merchant), b))[1] AS claimed FROM senders)
SELECT s_suppkey, CASE WHEN author IS NULL THEN 'no sender' WHEN domain IN ({_list_sql(CONSUMER)[1:-1]}) THEN 'consumer domain' WHEN claimed IS NOT NULL AND NOT contains(domain, replace(claimed, ' ', '')) THEN 'claims a brand' END AS distrust,
author IS NOT NULL AND len(list_filter({_list_sql(PLATFORMS)}, lambda p: domain = p OR ends_with(domain, '.' || p))) > 0 AS platform FROM c""")
def senders_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-2, PUR-7: why senders of receipts are not trusted, and which are platforms."""
    return _senders(spark, sf_dir).select("s_suppkey", trust_sender(F.col("author")).alias("distrust"), shared_sender(F.col("author")).alias("platform"))


@query(f"""WITH {_SENDERS}, k AS (SELECT *, {_KEY} AS key, trim(regexp_replace(regexp_replace(merchant, '(?i)\\ball rights reser?v?e?d?\\b\\.?', ''), '[\\s,;|-]+$', '')) AS clean FROM senders)
SELECT key, arg_min(merchant, (-length(merchant), -length(regexp_replace(merchant, '[^a-z]', '', 'g')), merchant)) AS shown, min(clean) AS clean, count(*) AS senders, len(list_filter({_list_sql(T.TRANSFERS)}, lambda m: starts_with(key, m))) > 0 AS transfer FROM k GROUP BY key""")
def merchants_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-5 to PUR-7, AGG-16: merchants by key with the name to show, and whether they only move money."""
    keyed = _senders(spark, sf_dir).select("merchant", T.merchant_key(F.col("merchant")).alias("key"), clean_merchant(F.col("merchant")).alias("clean"))
    grouped = keyed.groupBy("key").agg(display_merchant("merchant").alias("shown"), F.min("clean").alias("clean"), F.count(F.lit(1)).alias("senders"))
    return grouped.select("key", "shown", "clean", "senders", F.exists(F.array(*(F.lit(m) for m in T.TRANSFERS)), lambda m: F.startswith("key", m)).alias("transfer"))


@query("""WITH l AS (SELECT l_orderkey, list(round(l_extendedprice * 100)::BIGINT ORDER BY l_extendedprice) AS priced, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS lines FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, lines, len(priced) AS n, CASE WHEN o_orderkey % 9 = 0 THEN 'Order ' || o_orderkey WHEN o_orderkey % 9 = 1 THEN 'Your refund of ' || round(o_totalprice * 100)::BIGINT ELSE 'Total: ' || round(o_totalprice * 100)::BIGINT END AS body, CASE WHEN o_orderkey % 10 = 0 THEN '$5 off' ELSE 'Corner Shop' END AS merchant FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN cents <= 0 THEN 'no total' WHEN NOT contains(regexp_replace(body, '[^0-9]', '', 'g'), cents::VARCHAR) THEN 'total not in the text' WHEN n > 1 AND NOT (lines BETWEEN floor(cents * 0.4) AND ceil(cents * 1.5)) THEN 'lines do not add up' WHEN merchant = '$5 off' THEN 'no merchant' WHEN body LIKE '%refund%' THEN 'refund' END AS reason FROM r""")
def purchases_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-8, PUR-15: extracted totals held against their receipt's text and lines."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(cents)).alias("priced"))
    key, total = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    body = F.when(key % 9 == 0, F.concat(F.lit("Order "), key.cast("string"))).when(key % 9 == 1, F.concat(F.lit("Your refund of "), total.cast("string"))).otherwise(F.concat(F.lit("Total: "), total.cast("string")))
    receipts = table(spark, sf_dir, "orders").select("o_orderkey", total.alias("cents"), body.alias("body"), F.when(key % 10 == 0, "$5 off").otherwise("Corner Shop").alias("merchant")).join(lines, "o_orderkey")
    return receipts.select("o_orderkey", rejected(F.col("cents"), F.col("priced"), F.col("merchant"), F.col("body")).alias("reason"))


@query(f"""WITH {_SENDERS}, o AS (SELECT l_orderkey, l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, min(epoch_us(o_orderdate)) AS ordered, min(epoch_us(l_shipdate)) AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
c AS (SELECT l_suppkey, count(*) > 1 AND bool_or(cents < {LARGE}) AS corroborated FROM o GROUP BY l_suppkey),
j AS (SELECT o.*, merchant, domain, author, {_KEY} AS key, corroborated FROM o JOIN senders ON s_suppkey = l_suppkey JOIN c USING (l_suppkey)),
t AS (SELECT *, CASE WHEN len(list_filter({_list_sql(T.TRANSFERS)}, lambda m: starts_with(key, m))) > 0 THEN 'transfer' WHEN cents >= {LARGE} AND author IS NOT NULL AND len(list_filter({_list_sql(PLATFORMS)}, lambda p: domain = p OR ends_with(domain, '.' || p))) > 0 AND NOT corroborated THEN 'unconfirmed' ELSE 'purchase' END AS type,
  CASE WHEN ordered BETWEEN shipped - 30 * {DAY} AND shipped + 2 * {DAY} THEN ordered ELSE shipped END AS dated FROM j)
SELECT type, dated = ordered AS as_stated, count(*) AS purchases, sum(cents)::BIGINT AS cents, min(dated) AS first_t, max(dated) AS last_t FROM t GROUP BY ALL""")
def purchase_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-9 to PUR-11: purchases by type and by whether their stated date holds."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), micros("l_shipdate").alias("shipped"))
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), micros("o_orderdate").alias("ordered"))
    # Lines lie with their order, so that its purchases are summed where they have met it.
    met = lines.join(ordered, "l_orderkey")
    bought = met.groupBy("l_orderkey", "l_suppkey").agg(F.sum("cents").alias("cents"), F.min("shipped").alias("shipped"), F.min("ordered").alias("ordered"))
    # A supplier's purchases are alike but for their date and for being large, so names are read once a supplier.
    dated, large = purchase_date(F.col("ordered"), F.col("shipped")), F.col("cents") >= LARGE
    sums = bought.groupBy("l_suppkey", large.alias("large"), (dated == F.col("ordered")).alias("as_stated")).agg(F.count(F.lit(1)).alias("purchases"), F.sum("cents").alias("cents"), F.min(dated).alias("first_t"), F.max(dated).alias("last_t"))
    known = sums.groupBy("l_suppkey").agg(((F.sum("purchases") > 1) & F.bool_or(~F.col("large"))).alias("corroborated"), F.collect_list(F.struct("large", "as_stated", "purchases", "cents", "first_t", "last_t")).alias("sums"))
    joined = known.join(_senders(spark, sf_dir).withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").select("merchant", "author", "corroborated", F.explode("sums").alias("s"))
    typed = joined.select("s.*", typed_by(F.col("merchant"), F.col("s.large"), F.col("author"), F.col("corroborated")).alias("type"))
    return typed.groupBy("type", "as_stated").agg(F.sum("purchases").alias("purchases"), F.sum("cents").alias("cents"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


def alike(keyed: DataFrame) -> DataFrame:
    """PUR-4: (a, b) of (key): pairs of different keys that are one merchant's, the shorter first.

    The shorter is the longer without its last characters, three at most, and
    has twelve at least; so a key meets the keys that are equal to its own
    beginnings, and never all that begin like it.
    """
    keys = keyed.select("key").distinct()
    short = F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.left("key", F.char_length("key") - n)))
    longer = keys.filter(F.char_length("key") > LEAST_ALIKE).select(F.col("key").alias("b"), short.alias("a")).filter(F.char_length("a") >= LEAST_ALIKE)
    return longer.join(keys.withColumnRenamed("key", "a"), "a").select("a", "b")


_VARIED = f"CASE WHEN k % 8 = 3 AND k % 7 > 1 THEN regexp_replace(merchant, '[0-9] Store$', (((k - 1) % 10)::VARCHAR) || ' Store No') ELSE merchant END"


@query(f"""WITH {_SENDERS}, v AS (SELECT s_suppkey AS k, merchant FROM senders), m AS (SELECT k, {_VARIED} AS merchant FROM v), g AS (SELECT {_KEY} AS key, min(k) AS first, count(*) AS members FROM m GROUP BY 1)
SELECT x.first AS a, y.first AS b, x.members AS a_members, y.members AS b_members FROM g x JOIN g y ON starts_with(y.key, x.key) AND x.key <> y.key AND length(x.key) >= 12 AND length(y.key) - length(x.key) <= 3""")
def merchants_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUR-4: suppliers whose names are one merchant's; those of equal keys are one class, shown by its first supplier and its size."""
    k = F.col("s_suppkey")
    other = F.regexp_replace("merchant", F.lit("[0-9] Store$"), F.concat(((k - 1) % 10).cast("string"), F.lit(" Store No")))
    named = _senders(spark, sf_dir).select("s_suppkey", F.when((k % 8 == 3) & (k % 7 > 1), other).otherwise(F.col("merchant")).alias("merchant"))
    classes = named.groupBy(T.merchant_key(F.col("merchant")).alias("key")).agg(F.min("s_suppkey").alias("first"), F.count(F.lit(1)).alias("members"))
    pairs = alike(classes)
    left, right = classes.toDF("a", "first_a", "a_members"), classes.toDF("b", "first_b", "b_members")
    return pairs.join(left, "a").join(right, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"), "a_members", "b_members")
