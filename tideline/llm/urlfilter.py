"""URL filters: reversed-host keys turn rules into intervals; a sorted sweep carries the stack of nested rules."""
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, read_table
from .registry import query

#: Points of one host that a task sweeps, at least; hosts with more are salted, with their rules in every salt.
SWEEP_ROWS = 4096


def url_parts(column="url"):
    """``host, path`` as columns. Without ``://``, or for null, both are empty; host in lower case (A-Z)."""
    url = F.coalesce(F.col(column), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host).alias("host"), path.alias("path")


def reversed_key(host):
    """``a.example.com`` as ``com.example.a``: a host and its subdomains are then neighbours."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def nested_rules(rules):
    """Rules ``(host, path, verdict)`` with their key and stack: lengths and verdicts of the rules on the same host whose path starts theirs.

    Equal rules are one; where they disagree, block wins. Rules of an empty or null host fit nothing; a null path is empty.
    """
    own = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", reversed_key(F.col("host")))
    lens = own.groupBy("key").agg(F.collect_set(F.length("path")).alias("lens"))
    cuts = own.join(lens, "key").select("key", "path", F.explode("lens").alias("cut")).where("cut <= length(path)")
    cuts = cuts.select("key", "path", "cut", F.expr("left(path, cut)").alias("outer_path"))
    outer = own.select(F.col("key"), F.col("path").alias("outer_path"), "verdict")
    stack = cuts.join(outer, ["key", "outer_path"]).groupBy("key", "path").agg(
        F.array_sort(F.collect_list(F.struct("cut", "verdict"))).alias("stack"))
    return own.drop("verdict").join(stack, ["key", "path"])


def judge(pages, rules, default="allow", sweep_rows=SWEEP_ROWS):
    """``page_id, host, path, rule, verdict`` for every row of ``pages``, repeated rows and null urls included.

    A rule fits its host and all subdomains when the path starts with its path; the longest rule (host and path together) wins,
    block on a tie; no fit gives the default and a null rule. Each distinct (host, path) is swept once per host depth that the
    rules have. On one key, rules are intervals of paths, nested or apart. In path order, the last rule opened before a point, or one
    on its stack, holds the innermost interval around it. Other columns of ``pages`` are not read.
    """
    parsed = pages.select("page_id", *url_parts())
    own = nested_rules(rules)
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_rules"))
    depths = sorted(row.d for row in own.select(F.size(F.split("host", r"\.")).alias("d")).distinct().collect())
    points = parsed.select("host", "path").where("host <> ''").distinct()
    cut = [F.when(F.size(F.split("host", r"\.")) >= d, F.substring_index("host", ".", -d)) for d in depths] or [F.lit(None).cast("string")]
    points = points.select("host", "path", F.explode(F.array_distinct(F.array(*cut))).alias("at")).where("at is not null")
    points = points.select("host", "path", reversed_key(F.col("at")).alias("key"))
    load = points.join(sizes, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("n_rules").alias("n_rules"))
    load = load.select("key", F.expr(f"cast(ceil(n / greatest(n_rules, {sweep_rows})) as int)").alias("salts"))
    salted = points.join(load, "key").select("key", F.expr("pmod(xxhash64(host, path), salts)").alias("salt"), "path", "host", F.lit(1).alias("kind"),
                                             F.lit(None).cast("struct<path:string,host:string,stack:array<struct<cut:int,verdict:string>>>").alias("open"))
    opens = own.join(load, "key").select("key", F.explode(F.expr("sequence(0L, salts - 1L)")).alias("salt"), "path", "host", F.lit(0).alias("kind"),
                                         F.struct("path", "host", "stack").alias("open"))
    sweep = Window.partitionBy("key", "salt").orderBy("path", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = opens.unionByName(salted).withColumn("last", F.last("open", ignorenulls=True).over(sweep)).where("kind = 1 and last is not null")
    fit = F.expr("try_element_at(filter(last.stack, s -> startswith(path, left(last.path, s.cut))), -1)")
    best = swept.select("host", "path", fit.alias("fit"), F.col("last.host").alias("rule_host"), F.col("last.path").alias("rule_path"))
    best = best.where("fit is not null").selectExpr("host", "path", "concat(rule_host, left(rule_path, fit.cut)) as rule", "fit.verdict as verdict")
    best = best.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("top"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


#: Fixed values of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"))

SQL = r"""
with rules(rh, rp, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest as (select page_id, row_number() over () as r, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as t from pages),
part as (select page_id, r, regexp_extract(t, '^[^/?#]*') as h, regexp_extract(substr(t, length(regexp_extract(t, '^[^/?#]*')) + 1), '^[^?#]*') as path from rest),
page as (select page_id, r, path, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from part),
fit as (select r, rh || rp as rule, verdict, row_number() over (partition by r order by length(rh || rp) desc) as k
        from page join rules on (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from page left join (select * from fit where k = 1) using (r)
"""


@query("op2_url_filters", SQL)
def op2(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), spark.createDataFrame(RULES, "host string, path string, verdict string"))
