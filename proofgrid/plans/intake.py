"""Queries over what comes in: captured responses, structured texts, formats, values, keys. Bodies are made of the given
tables' rows, so that their rows say what has to be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats as M
from ..operators import attack, trust
from ..sources import responses as R
from ..sources import structured, tables
from ..sources.adapters import CURRENCY, TWINS, observations
from ..sources.tables import read
from ..streaming import watch


def text(column) -> F.Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# responses


def dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text(F.floor(F.col("value") / 20))
    body = F.concat(F.lit('{"rtype":"'), F.when(F.col("event_type") == "view", "A").otherwise("CNAME"), F.lit('","records":["h'), k, F.lit('.example.","","k'), k, F.lit('"]}'))
    return R.dns(read(spark, sf_dir, "events").select(text("event_id").alias("target"), body.alias("body")))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third customer's registrar has no card, so its handle counts."""
    k = text("c_custkey")
    card = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(',"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","'), F.col("c_mktsegment"), F.lit(' Inc"]]]'))).otherwise("")
    body = F.concat(F.lit('{"entities":[{"roles":["Registrar"],"handle":"h'), k, F.lit('"'), card, F.lit('}],"status":["active","locked"],"events":[{"eventAction":"expiration","eventDate":"d'), k, F.lit('"}],"nameservers":[{"ldhName":"ns.'), k, F.lit('.example."}]}'))
    return R.registration(read(spark, sf_dir, "customer").select(k.alias("target"), body.alias("body")))


def certificate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text("s_suppkey")
    body = F.concat(F.lit('[{"name_value":"*.d'), k, F.lit(".example\\nWWW.d"), k, F.lit('.example"},{"name_value":"d'), k, F.lit('.example, mail.d'), k, F.lit('.example"}]'))
    return R.certificate_names(read(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k, F.lit(".example")).alias("target"), body.alias("body")))


def address_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = F.struct((k % 5 != 0).alias("success"), F.concat(F.lit("10.1."), text(k)).alias("ip"), F.when(k % 2 == 0, F.concat(F.lit("AS"), text(k))).otherwise("none").alias("asn"), F.when(k % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("org"), F.lit("an isp").alias("isp"), F.lit("").alias("country_code"), text("c_nationkey").alias("country"), (k % 90 + 0.5).alias("lat"), (k % 180 + 0.25).alias("lng"))
    return R.address_facts(read(spark, sf_dir, "customer").select(text(k).alias("target"), F.to_json(fields).alias("body")))


def archive_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text("page_id")
    body = F.concat(F.lit('[["urlkey","original","timestamp"],["k","http://p/'), k, F.lit('","2020'), k, F.lit('"],["k","http://q/'), k, F.lit('","2021'), k, F.lit('"]]'))
    return R.snapshots(read(spark, sf_dir, "pages").select(k.alias("target"), body.alias("body")))


def reverse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text("s_suppkey")
    body = F.when(F.col("s_suppkey") % 4 == 0, "error invalid").otherwise(F.concat(F.lit("a"), k, F.lit(".example\r\n\r\n b"), k, F.lit(".example ")))
    return R.reverse_names(read(spark, sf_dir, "supplier").select(k.alias("target"), body.alias("body")))


def advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text("p_partkey")
    cve = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"cve-2024-'), k, F.lit('"'))).otherwise("")
    body = F.concat(F.lit('{"vulns":[{"id":"OSV-'), k, F.lit('","aliases":["GHSA-'), k, F.lit('"'), cve, F.lit('],"summary":"'), F.col("p_name"), F.lit('"}]}'))
    return R.vulnerabilities(read(spark, sf_dir, "part").select(k.alias("target"), body.alias("body")))


def chain_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = text("o_orderkey"), text("o_custkey")
    body = F.concat(F.lit('[{"txid":"t'), k, F.lit('","vin":[{"prevout":{"scriptpubkey_address":"b'), c, F.lit('"}},{"prevout":{"scriptpubkey_address":"a'), c, F.lit('"}},{"prevout":{"scriptpubkey_address":"b'), c, F.lit('"}}],"vout":[{"scriptpubkey_address":"z'), k, F.lit('"},{}]}]'))
    return R.transactions(read(spark, sf_dir, "orders").select(k.alias("target"), body.alias("body")))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text("p_partkey")
    item = lambda n: F.concat(F.lit(f"<item><title>{n} "), F.col("p_name"), F.lit(f"</title><link>http://f/{n}/"), k, F.lit("</link><pubDate>d"), k, F.lit("</pubDate></item>"))
    body = F.concat(F.lit("<rss><channel><title>t</title>"), item("one"), item("two"), F.lit("</channel></rss>"))
    return R.feed_items(read(spark, sf_dir, "part").select(k.alias("target"), body.alias("body")))


# structured texts


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("props", "([0-9]+)", 1)
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"a/b":{"k":'), n, F.lit(',"list":[1,{"x~y":"z'), n, F.lit('"}]},"u":"'), text("user_id"), F.lit('","none":{},"empty":[]}')).alias("body"))


def json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.json_leaves(nested(spark, sf_dir), "event_id", F.col("body"))


def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.schema_of_records(structured.json_leaves(nested(spark, sf_dir), "event_id", F.col("body")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and its lines in order; an order has few."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round("l_quantity").cast("long").alias("q"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as delimited texts, in four delimiters, every second with a header."""
    k = F.col("o_orderkey")
    d = pick((",", "\t", "|", ";"), k)
    rows = F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), d, x["l_partkey"].cast("string"), d, x["q"].cast("string")))
    head = F.when(k % 2 == 0, F.array(F.concat(F.lit("line"), d, F.lit("part key"), d, F.lit("qty")))).otherwise(F.array().cast("array<string>"))
    return structured.delimited_cells(order_lines(spark, sf_dir).select(k, F.array_join(F.concat(head, rows), "\n").alias("body")), "o_orderkey", F.col("body"))


def xml_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform("lines", lambda x: F.concat(F.lit("<line><part>"), x["l_partkey"].cast("string"), F.lit("</part><qty>"), x["q"].cast("string"), F.lit("</qty></line>")))
    bodies = order_lines(spark, sf_dir).select("o_orderkey", F.concat(F.lit("<order>"), F.array_join(rows, ""), F.lit("</order>")).alias("body"))
    return structured.xml_rows(bodies, "o_orderkey", F.col("body"), "line", "part:long,qty:long")


def json_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as JSON lines; each thirteenth is cut off, each seventeenth blank."""
    e = F.col("event_id")
    line = F.when(e % 17 == 0, " ").when(e % 13 == 0, '{"k": ').otherwise(F.col("props"))
    return structured.json_line_quality(read(spark, sf_dir, "events").select("user_id", line.alias("line")), "user_id")


def ini_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as settings files: comments, a section, quoted and exported values."""
    k = text("c_custkey")
    lines = F.array(F.lit("# a comment = no"), F.concat(F.lit("top="), k), F.concat(F.lit("[seg."), F.col("c_mktsegment"), F.lit("]")), F.concat(F.lit('name = "'), F.col("c_name"), F.lit('"')), F.lit(""), F.concat(F.lit("export NATION: '"), text("c_nationkey"), F.lit("' ")))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "line"))
    return tables.key_values(rows)


# formats and values


CELLS = {"customer": ("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "orders": ("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "pages": ("page_id", "url"), "part": ("p_name", "p_brand"), "documents": ("lang", "source", "n_chars")}


def value_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of a column have each tag, and what the column's name says."""
    cells = None
    for name, columns in CELLS.items():
        rows = read(spark, sf_dir, name).select(F.explode(F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
        cells = rows if cells is None else cells.union(rows)
    tagged = cells.select("table_name", "column_name", F.explode(M.value_tags(F.col("value"))).alias("tag"))
    return tagged.groupBy("table_name", "column_name", "tag").agg(F.count(F.lit(1)).alias("n")).withColumn("role", M.name_role(F.col("column_name")))


KEYS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"), ("orders", "o_orderkey", "customer", "c_custkey"))


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For pairs of columns of one name: how many values the other table lacks, and whether the key holds."""
    out = None
    for table, column, other, key in KEYS:
        values = read(spark, sf_dir, table).select(F.col(column).cast("long").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        there = read(spark, sf_dir, other).select(F.col(key).cast("long").alias("v")).distinct().withColumn("there", F.lit(True))
        row = values.join(there, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
        row = row.select(F.lit(f"{table}.{column}").alias("from_column"), F.lit(f"{other}.{key}").alias("to_column"), "n_rows", "n_missing", (F.col("n_missing") == 0).alias("holds"))
        out = row if out is None else out.union(row)
    return out


EXTENSIONS = ("txt", "tar.gz", "JSON", "warc.gz", "pdf", "xyz", "csv", "cdx.json", "kml")
SPELLED = ("TEXT/YAML; charset=utf-8", "application/json", "text/xml", " ", "image/png", "application/x-ndjson")


def media_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files: type by name, another type normalised, whether the two are of a family, whether format and content go together."""
    k = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), pick(EXTENSIONS, k))
    given = M.normal_media(pick(SPELLED, k))
    named, found = pick(("zip", "json", "csv", "text", "jpeg"), k), pick(("docx", "geojson", "xlsx", "yaml", "png", "pdf"), k)
    rows = read(spark, sf_dir, "part").select(k, M.media_of_name(name).alias("by_name"), given.alias("given"), M.formats_compatible(named, found).alias("compatible"))
    return rows.withColumn("family", F.coalesce(M.media_family(F.col("by_name"), F.col("given")), F.lit(False)))


SAMPLES = (
    ("json", '{"type":"FeatureCollection"}', "geojson"), ("json", '{"spec_version":"2.1"}', "stix2"), ("json", '{"Version":1,"Runs":[]}', "sarif"), ("json", '{"a":', "json"), ("xml", "<?xml?><KML>", "kml"), ("xml", "<rdf:RDF>", "rdf"), ("xml", "<other/>", "xml"), ("csv", "a,b", "csv"),
)


def refined_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind heads of several formats: what their content is, and whether it looks binary."""
    k = F.col("doc_id")
    body = F.concat(pick(tuple(s[1] for s in SAMPLES), k), F.when(k % 3 == 0, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(""))
    json_only = F.when(k % 8 < 4, pick(tuple(s[1] for s in SAMPLES), k)).otherwise(body)
    content = F.when(k % 5 == 0, F.concat(F.encode(F.left(F.coalesce("text", F.lit("")), F.lit(50)), "UTF-8"), F.unhex(F.lit("00")))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return read(spark, sf_dir, "documents").select(k, M.refined_format(pick(tuple(s[0] for s in SAMPLES), k), json_only).alias("format"), M.looks_binary(content).alias("binary"))


HOSTS = ("http://10.0.0.8/x", "https://example.org/a", "ftp://example.org", "http://user@192.168.1.9:80/", "http://[::1]/", "http:///x", "http://172.32.0.1/", "HTTP://LOCALHOST/", "http://[fe80::1]/", "http://203.0.113.7")


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which URLs are safe to fetch, and where redirects lead."""
    e = F.col("event_id")
    url = F.concat(pick(HOSTS, e), F.when(e % 3 == 0, "?q=1").otherwise(""))
    link = F.when(e % 2 == 0, F.concat(F.lit("//s.example/l/?uddg=http%3A%2F%2Ft.example%2F"), text("user_id"), F.lit("&r=1"))).otherwise(F.concat(F.lit("http://t.example/"), text("user_id")))
    return read(spark, sf_dir, "events").select(e, M.url_safety(url).alias("unsafe"), M.unwrapped(link).alias("target"))


def chain_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, digest = F.col("c_custkey"), F.sha2("c_name", 256)
    address = F.when(k % 3 == 0, F.concat(F.lit("0x"), F.left(digest, F.lit(40)))).when(k % 3 == 1, F.concat(F.lit("1"), F.translate(F.left(digest, F.lit(30)), "0", "o"))).otherwise(F.left(digest, F.lit(12)))
    chain = pick(("ethereum", "bitcoin", "ethereum", "ethereum", "bitcoin", "dogecoin"), k)
    return read(spark, sf_dir, "customer").select(k, M.chain_address(chain, address).alias("verdict"), M.valid_transaction_hash(F.when(k % 2 == 0, digest).otherwise(F.left(digest, F.lit(63)))).alias("tx_hash"), M.valid_identifier(F.concat(F.when(k % 4 == 0, "Case").otherwise("case"), F.lit("_"), F.left(digest, (k % 12).cast("int")))).alias("identifier"))


def claim_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first line comes to the same claim, and the years it is given."""
    line = F.left(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.lit(60))
    k = F.col("doc_id")
    dated = F.concat(line, F.when(k % 3 != 0, F.concat(F.lit(" in "), text(1890 + k % 40))).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit(" or "), text(2090 + k % 20))).otherwise(""))
    years = M.year_window(F.regexp_replace(dated, r"^.*?( in | or )", "$1"))
    rows = read(spark, sf_dir, "documents").select(k, M.claim_key(line).alias("claim"), F.when(dated.rlike(" (in|or) [0-9]{4}"), years).alias("y"))
    return rows.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.min("y.first").alias("first_year"), F.max("y.last").alias("last_year"))


def list_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose values are lists: the order of a list and the case of its items don't make another value."""
    e = F.col("event_id")
    items = F.when(e % 2 == 0, F.array(F.lit("Alpha. "), text(F.floor(F.col("value") / 100)))).otherwise(F.array(text(F.floor(F.col("value") / 100)), F.lit("alpha")))
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", trust.canonical_list(items).alias("canon"))
    return rows.groupBy("user_id", "event_type").agg(F.countDistinct("canon").alias("n_values"), F.min("canon").alias("least"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as cached results by case and content, with an age by turn: which are still fresh."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    key = F.concat(text("conv_id"), F.lit(":"), content, F.when(F.col("turn") % 2 == 0, "|m1|p1|").otherwise(""))
    age, most = F.col("turn") * 200, F.when(F.col("role") == "system", 86400).when(F.col("role") == "user", 300).otherwise(3600)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"), (age <= most).alias("fresh"))


def plan_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines ask for the same set of part groups are one plan; the questions each asks of its customer."""
    groups = F.transform("lines", lambda x: F.concat(F.lit("g"), (x["l_partkey"] % 4).cast("string")))
    prints = order_lines(spark, sf_dir).select("o_orderkey", F.sha2(F.array_join(F.array_sort(F.array_distinct(groups)), "|"), 256).alias("fingerprint"))
    return prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates filled with each supplier's name."""
    templates = F.array(F.lit("Who operates {target}?"), F.lit("When was {target} first seen?"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(templates).alias("t"), "s_name").select("s_suppkey", F.replace("t", F.lit("{target}"), F.col("s_name")).alias("question"))


def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as films of so many seconds: moments spread evenly, without the first and last twentieth."""
    n = (F.col("p_partkey") % 4 + 1).cast("int")
    low, high = F.col("p_size") * 0.05, F.col("p_size") * 0.95
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.round(F.when(n == 1, (low + high) / 2).otherwise(low + (high - low) * k / (n - 1)), 3))
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(at).alias("k", "second"))


# registries, alerts, progress


def evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations may rest only on bytes that are stored: turns looked up by hash among all turns of other conversations, first match."""
    hashed = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("conv_id", "turn")).alias("s"), F.countDistinct("conv_id").alias("n_cases"))
    return hashed.join(first, "sha256").select("conv_id", "turn", F.col("s.conv_id").alias("first_conv"), F.col("s.turn").alias("first_turn"), "n_cases")


def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each collection holds, and how many ids twice."""
    out = None
    for name, key in (("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id"), ("lineitem", "l_orderkey")):
        counts = read(spark, sf_dir, name).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        row = counts.agg(F.lit(name).alias("collection"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 1).alias("n_repeated"))
        out = row if out is None else out.union(row)
    return out


RULES = [{"rule_id": "r-the", "keyword": '"The"', "languages": ["en"]}, {"rule_id": "r-die", "keyword": "die", "languages": []}, {"rule_id": "r-en", "keyword": "en", "languages": ["de", "fr"]}]


def watch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule finds by first lines and language, by story, with the note on corroboration."""
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    hits = watch.matched(read(spark, sf_dir, "documents"), RULES, title, F.col("lang"))
    stories = hits.groupBy("rule_id", F.left(F.lower(title), F.lit(80)).alias("story")).agg(F.min("doc_id").alias("earliest"), F.count(F.lit(1)).alias("n_copies"), F.greatest(F.lit(1).cast("long"), F.countDistinct("source")).alias("publishers"))
    return stories.select("rule_id", "earliest", "n_copies", watch.corroboration(F.col("publishers")).alias("note"))


def proactive_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New contradictions by severity: those whose key was known before the cut are left out."""
    obs = observations(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    found = trust.contradictions(obs).withColumn("severity", F.round(F.least(F.lit(1.0), F.col("n_values") / 5.0), 6))
    seen = trust.contradictions(obs.where(F.col("observed_at") < cut)).select("subject", "predicate")
    new = found.where("severity >= 0.6").join(seen, ["subject", "predicate"], "left_anti")
    return new.select("subject", "predicate", "severity", F.when(F.col("severity") >= 0.8, "critical").otherwise("high").alias("priority"))


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' runs: why each stops, what its progress is, by gaps, failures and observations."""
    v = F.col("value")
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(v < 30).alias("failed"), F.count_if(v > 180).alias("gaps"), F.count_if((v >= 100) & (F.col("event_type") == "view")).alias("found"))
    reason = F.when((F.col("gaps") > 0) & (F.col("user_id") % 3 == 0), "LOW_EXPECTED_INFORMATION_VALUE").when(F.col("failed") * 2 > F.col("n"), "SOURCES_EXHAUSTED").when(F.col("found") > 0, "OBJECTIVE_SATISFIED").otherwise("MISSING_EVIDENCE")
    ratio = lambda done, total: F.round(F.coalesce(F.try_divide(done, total), F.lit(0.0)), 3)
    return rows.select("user_id", reason.alias("reason"), ratio(F.col("n") - F.col("failed"), F.col("n")).alias("task_progress"), ratio(F.col("found"), F.col("found") + F.col("gaps")).alias("gap_progress"))


def registry_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority, and the share of each status."""
    rows = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_cases"), F.max("o_orderdate").cast("date").cast("string").alias("newest"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))  # one row a status


def latest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest orders of each currency's tenant."""
    tenant = F.element_at(F.array(*map(F.lit, CURRENCY)), (F.col("o_custkey") % 5 + 1).cast("int"))
    order = Window.partitionBy("tenant").orderBy(F.col("o_orderkey").desc())
    return read(spark, sf_dir, "orders").select(tenant.alias("tenant"), "o_orderkey", "o_orderstatus").withColumn("place", F.row_number().over(order)).where("place <= 100")


def phase_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of target to domains of intelligence; kinds without one go to the general domain."""
    table = {"view": "web", "click": "web", "signup": "identity", "purchase": "finance"}
    domain = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type")), F.lit("general"))
    return read(spark, sf_dir, "events").select("user_id", domain.alias("domain"), attack.parent(F.concat_ws(".", "event_type", F.lit("1"))).alias("target")).groupBy("user_id", "domain").agg(F.countDistinct("target").alias("n_targets"))


QUERIES = {
    f.__name__: f
    for f in (
        dns_records, registrations, certificate_names, address_facts, archive_snapshots, reverse_names, advisories, chain_transactions, feed_items, json_tree, json_schema, delimited_cells, xml_leaves, json_line_quality, ini_settings, value_tags, foreign_keys, media_names, refined_formats, url_checks,
        chain_addresses, claim_keys, list_claims, cache_keys, plan_fingerprints, questions, sample_times, evidence_lookup, collection_counts, watch_rules, proactive_alerts, stop_reasons, registry_coverage, latest_cases, phase_domains,
    )
}

_PICK = lambda values, n: f"({list(values)})[({n}) % {len(values)} + 1]"
_LINES = "l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, round(l_quantity)) - 1 AS i, l_linenumber AS n, l_partkey AS p, round(l_quantity)::BIGINT AS q FROM lineitem)"
_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, trim({'strftime(o_orderdate, ' + chr(39) + '%Y-%m-%d %H:%M:%S' + chr(39) + ')' if c == 'o_orderdate' else c + '::VARCHAR'}) AS v FROM {t}" for t, columns in CELLS.items() for c in columns)
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(v, '{p}') THEN '{t}'" for t, p in M.FIRST_OF.items()) + " END"
_HASHES = "CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN CASE length(v) " + " ".join(f"WHEN {n} THEN 'hash_{h}'" for n, h in M.HASH_DIGITS.items()) + " END END"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(column_name, '(?i){p}') THEN '{r}'" for p, r in M.ROLES) + " END"
_PAIRS = "list_contains([" + ", ".join(f"'{a}>{b}'" for a in ("zip", "json", "csv", "text", "jpeg") for b in ("docx", "geojson", "xlsx", "yaml", "png", "pdf") if a == b or b in M.MAY_BE.get(a, ()) or any(a in g and b in g for g in M.ALIKE)) + "], {x})"
_UNSAFE = ("private or reserved address", "", "scheme not allowed", "private or reserved address", "private or reserved address", "missing host", "", "private or reserved address", "private or reserved address", "private or reserved address")
ORACLES = {
    "dns_records": """WITH k AS (SELECT event_id::VARCHAR AS subject, CASE WHEN event_type = 'view' THEN 'dns.a' ELSE 'dns.cname' END AS predicate, floor(value / 20)::BIGINT AS k FROM events)
        SELECT subject, predicate, unnest(['h' || k || '.example', 'k' || k]) AS value FROM k""",
    "registrations": """SELECT c_custkey::VARCHAR AS subject, 'registrar' AS predicate, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' Inc' ELSE 'h' || c_custkey END AS value FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'registration.status', 'active|locked' FROM customer
        UNION ALL SELECT c_custkey::VARCHAR, 'registration.event.expiration', 'd' || c_custkey FROM customer UNION ALL SELECT c_custkey::VARCHAR, 'domain.nameserver', 'ns.' || c_custkey || '.example' FROM customer""",
    "certificate_names": "SELECT 'd' || s_suppkey || '.example' AS subject, 'domain.subdomain_seen_in_ct' AS predicate, unnest(['www.d' || s_suppkey || '.example', 'mail.d' || s_suppkey || '.example']) AS value FROM supplier",
    "address_facts": """WITH c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS subject, c_mktsegment AS m, c_nationkey AS n FROM customer WHERE c_custkey % 5 <> 0)
        SELECT subject, 'ip.address' AS predicate, '10.1.' || k AS value FROM c UNION ALL SELECT subject, 'ip.asn', 'AS' || k FROM c WHERE k % 2 = 0 UNION ALL SELECT subject, 'ip.organization', CASE WHEN k % 3 = 0 THEN 'an isp' ELSE m END FROM c UNION ALL SELECT subject, 'ip.country', n::VARCHAR FROM c
        UNION ALL SELECT subject, 'ip.location', (k % 90) || '.5,' || (k % 180) || '.25' FROM c""",
    "archive_snapshots": "SELECT page_id::VARCHAR AS subject, 'archive.snapshot' AS predicate, unnest(['2020' || page_id || ' http://p/' || page_id, '2021' || page_id || ' http://q/' || page_id]) AS value FROM pages",
    "reverse_names": "SELECT s_suppkey::VARCHAR AS subject, 'ptr.hostname' AS predicate, unnest(['a' || s_suppkey || '.example', 'b' || s_suppkey || '.example']) AS value FROM supplier WHERE s_suppkey % 4 <> 0",
    "advisories": """SELECT p_partkey::VARCHAR AS subject, 'package.vulnerability' AS predicate, '{"osv_id":"OSV-' || p_partkey || '",' || CASE WHEN p_partkey % 2 = 0 THEN '"cve":"cve-2024-' || p_partkey || '",' ELSE '' END || '"summary":"' || p_name || '"}' AS value FROM part""",
    "chain_transactions": """SELECT o_orderkey::VARCHAR AS subject, 'wallet.transaction' AS predicate, '{"txid":"t' || o_orderkey || '","inputs":["a' || o_custkey || '","b' || o_custkey || '"],"outputs":["z' || o_orderkey || '"]}' AS value FROM orders""",
    "feed_items": """SELECT p_partkey::VARCHAR AS subject, 'feed.item' AS predicate, '{"title":"' || n || ' ' || p_name || '","link":"http://f/' || n || '/' || p_partkey || '","published":"d' || p_partkey || '"}' AS value FROM (SELECT *, unnest(['one', 'two']) AS n FROM part)""",
    "json_tree": """WITH k AS (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS n, user_id::VARCHAR AS u FROM events), x AS (SELECT event_id, unnest([{'p': '/a~1b/k', 'd': 'a/b.k', 'v': n}, {'p': '/a~1b/list/0', 'd': 'a/b.list[0]', 'v': '1'}, {'p': '/a~1b/list/1/x~0y', 'd': 'a/b.list[1].x~y', 'v': 'z' || n},
        {'p': '/u', 'd': 'u', 'v': u}, {'p': '/none', 'd': 'none', 'v': '{}'}, {'p': '/empty', 'd': 'empty', 'v': '[]'}]) AS l FROM k) SELECT event_id, l.p AS pointer, l.d AS path, l.v AS value FROM x""",
    "json_schema": "SELECT path, count(*) AS n FROM (SELECT unnest(['a/b.k', 'a/b.list[]', 'a/b.list[].x~y', 'u', 'none', 'empty']) AS path FROM events) GROUP BY 1",
    "delimited_cells": f"""WITH {_LINES} SELECT k AS o_orderkey, (i + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS line_no, c AS column_no, CASE WHEN k % 2 = 0 THEN (['line', 'part key', 'qty'])[c + 1] ELSE 'c' || c END AS name, (CASE c WHEN 0 THEN n WHEN 1 THEN p ELSE q END)::VARCHAR AS value FROM l, (SELECT unnest([0, 1, 2]) AS c)""",
    "xml_leaves": f"WITH {_LINES} SELECT k AS o_orderkey, '/line[' || (i + 1) || ']/' || c AS locator, c AS name, CASE c WHEN 'part' THEN p ELSE q END::VARCHAR AS value FROM l, (SELECT unnest(['part', 'qty']) AS c)",
    "json_line_quality": """WITH e AS (SELECT user_id, event_id % 13 <> 0 AS fine FROM events WHERE event_id % 17 <> 0) SELECT user_id, count_if(fine)::BIGINT AS good, count_if(NOT fine)::BIGINT AS bad, round(0.95::DOUBLE * count_if(fine) / count(*), 6) AS confidence FROM e GROUP BY 1""",
    "ini_settings": """SELECT c_custkey AS doc_id, 1 AS line_no, '' AS section, 'top' AS key, c_custkey::VARCHAR AS value FROM customer UNION ALL SELECT c_custkey, 3, 'seg.' || c_mktsegment, 'name', c_name FROM customer
        UNION ALL SELECT c_custkey, 5, 'seg.' || c_mktsegment, 'NATION', c_nationkey::VARCHAR FROM customer""",
    "value_tags": f"""WITH c AS ({_CELLS}), t AS (SELECT table_name, column_name, unnest(CASE WHEN coalesce(v, '') = '' THEN ['empty'] ELSE list_filter([{", ".join(f"CASE WHEN regexp_matches(v, '{p}') THEN '{t}' END" for t, p in M.TAGS.items())}, {_FIRST}, {_HASHES}], lambda x: x IS NOT NULL) END) AS tag FROM c)
        SELECT table_name, column_name, tag, count(*) AS n, {_ROLE} AS role FROM t GROUP BY ALL""",
    "foreign_keys": " UNION ALL ".join(f"SELECT '{t}.{c}' AS from_column, '{o}.{k}' AS to_column, count(*) AS n_rows, count_if(NOT there)::BIGINT AS n_missing, count_if(NOT there) = 0 AS holds FROM (SELECT {c} IN (SELECT {k} FROM {o}) AS there FROM {t})" for t, c, o, k in KEYS),
    "media_names": f"""WITH k AS (SELECT p_partkey, {_PICK(("text/plain", "application/gzip", "application/json", "application/warc-gzip", "application/pdf", "", "text/csv", "application/vnd.cyclonedx+json", "application/vnd.google-earth.kml+xml"), "p_partkey")} AS a, {_PICK(("application/yaml", "application/json", "application/xml", "", "image/png", "application/x-ndjson"), "p_partkey")} AS b,
        {_PAIRS.format(x=_PICK(("zip", "json", "csv", "text", "jpeg"), "p_partkey") + " || '>' || " + _PICK(("docx", "geojson", "xlsx", "yaml", "png", "pdf"), "p_partkey"))} AS compatible FROM part)
        SELECT p_partkey, nullif(a, '') AS by_name, nullif(b, '') AS given, compatible, a <> '' AND b <> '' AND split_part(a, '/', 1) = split_part(b, '/', 1) AND (split_part(a, '/', 2) IN {M.SHARED_SUBTYPES} OR split_part(b, '/', 2) IN {M.SHARED_SUBTYPES}) AS family FROM k""",
    "refined_formats": f"SELECT doc_id, {_PICK(tuple(s[2] for s in SAMPLES), 'doc_id')} AS format, doc_id % 5 = 0 AS binary FROM documents",
    "url_checks": f"""SELECT event_id, {_PICK(_UNSAFE, "event_id")} AS unsafe, 'http://t.example/' || user_id AS target FROM events""",
    "chain_addresses": r"""WITH k AS (SELECT c_custkey, sha256(c_name) AS d FROM customer), a AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN '0x' || left(d, 40) WHEN 1 THEN '1' || replace(left(d, 30), '0', 'o') ELSE left(d, 12) END AS address, (['ethereum', 'bitcoin', 'ethereum', 'ethereum', 'bitcoin', 'dogecoin'])[c_custkey % 6 + 1] AS chain FROM k)
        SELECT c_custkey, CASE chain WHEN 'bitcoin' THEN CASE WHEN regexp_matches(address, '^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$|^(bc1|tb1)[acdefghjklmnpqrstuvwxyz02-9]{11,87}$') THEN 'valid_bitcoin' ELSE 'invalid_bitcoin' END
        WHEN 'ethereum' THEN CASE WHEN c_custkey % 3 = 0 THEN 'valid_ethereum' ELSE 'invalid_ethereum' END ELSE 'unsupported_chain:dogecoin' END AS verdict, c_custkey % 2 = 0 AS tx_hash, c_custkey % 4 <> 0 AND c_custkey % 12 >= 8 AS identifier FROM a""",
    "claim_keys": r"""WITH k AS (SELECT doc_id, trim(regexp_replace(lower(left(split_part(coalesce(text, ''), chr(10), 1), 60)), '[^a-z0-9]+', ' ', 'g')) AS claim, list_filter([CASE WHEN doc_id % 3 <> 0 AND doc_id % 40 >= 10 THEN 1890 + doc_id % 40 END, CASE WHEN doc_id % 5 = 0 AND doc_id % 20 < 10 THEN 2090 + doc_id % 20 END], lambda x: x IS NOT NULL) AS y FROM documents)
        SELECT claim, count(*) AS n, min(list_min(y))::INTEGER AS first_year, max(list_max(y))::INTEGER AS last_year FROM k GROUP BY 1""",
    "list_claims": "WITH k AS (SELECT user_id, event_type, floor(value / 100)::BIGINT || '|alpha' AS canon FROM events) SELECT user_id, event_type, count(DISTINCT canon) AS n_values, min(canon) AS least FROM k GROUP BY 1, 2",
    "cache_keys": "SELECT conv_id, turn, conv_id || ':' || sha256(coalesce(text, '')) || CASE WHEN turn % 2 = 0 THEN '|m1|p1|' ELSE '' END AS key, turn * 200 <= CASE role WHEN 'system' THEN 86400 WHEN 'user' THEN 300 ELSE 3600 END AS fresh FROM conversations",
    "plan_fingerprints": "WITH g AS (SELECT l_orderkey AS k, sha256(string_agg(DISTINCT 'g' || (l_partkey % 4), '|' ORDER BY 'g' || (l_partkey % 4))) AS fingerprint FROM lineitem GROUP BY 1) SELECT fingerprint, count(*) AS n, min(k) AS first_order FROM g GROUP BY 1",
    "questions": "SELECT s_suppkey, unnest(['Who operates ' || s_name || '?', 'When was ' || s_name || ' first seen?']) AS question FROM supplier",
    "sample_times": """WITH k AS (SELECT p_partkey, p_size * 0.05::DOUBLE AS low, p_size * 0.95::DOUBLE AS high, p_partkey % 4 + 1 AS n, unnest(range(p_partkey % 4 + 1)) AS k FROM part)
        SELECT p_partkey, k::INTEGER AS k, round(CASE WHEN n = 1 THEN (low + high) / 2 ELSE low + (high - low) * k / (n - 1) END, 3) AS second FROM k""",
    "evidence_lookup": "WITH h AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS s FROM conversations), f AS (SELECT s, arg_min({'c': conv_id, 't': turn}, {'c': conv_id, 't': turn}) AS f, count(DISTINCT conv_id) AS n_cases FROM h GROUP BY 1) SELECT conv_id, turn, f.f.c AS first_conv, f.f.t AS first_turn, n_cases FROM h JOIN f USING (s)",
    "collection_counts": " UNION ALL ".join(f"SELECT '{t}' AS collection, coalesce(sum(n), 0)::BIGINT AS n, count_if(n > 1)::BIGINT AS n_repeated FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})" for t, k in (("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("pages", "page_id"), ("lineitem", "l_orderkey"))),
    "watch_rules": """WITH d AS (SELECT doc_id, lang, source, lower(split_part(coalesce(text, ''), chr(10), 1)) AS t FROM documents), h AS (SELECT 'r-the' AS rule_id, * FROM d WHERE contains(t, 'the') AND (lang IS NULL OR lang = 'en') UNION ALL SELECT 'r-die', * FROM d WHERE contains(t, 'die') UNION ALL SELECT 'r-en', * FROM d WHERE contains(t, 'en') AND (lang IS NULL OR lang IN ('de', 'fr'))),
        s AS (SELECT rule_id, left(t, 80) AS story, min(doc_id) AS earliest, count(*) AS n_copies, greatest(1, count(DISTINCT source)) AS p FROM h GROUP BY 1, 2) SELECT rule_id, earliest, n_copies, CASE WHEN p <= 1 THEN 'single-source story' ELSE p || ' independent publishers' END AS note FROM s""",
    "proactive_alerts": TWINS["observations"] + """, f AS (SELECT lower(subject) AS subject, lower(predicate) AS predicate, count(DISTINCT lower(trim(value))) AS n, count(DISTINCT lower(trim(value))) FILTER (observed_at < '2024-01-16') AS before FROM obs GROUP BY 1, 2),
        s AS (SELECT subject, predicate, round(least(1.0::DOUBLE, n / 5.0), 6) AS severity FROM f WHERE n > 1 AND before <= 1) SELECT *, CASE WHEN severity >= 0.8 THEN 'critical' ELSE 'high' END AS priority FROM s WHERE severity >= 0.6""",
    "stop_reasons": """WITH r AS (SELECT user_id, count(*) AS n, count_if(value < 30) AS failed, count_if(value > 180) AS gaps, count_if(value >= 100 AND event_type = 'view') AS found FROM events GROUP BY 1)
        SELECT user_id, CASE WHEN gaps > 0 AND user_id % 3 = 0 THEN 'LOW_EXPECTED_INFORMATION_VALUE' WHEN failed * 2 > n THEN 'SOURCES_EXHAUSTED' WHEN found > 0 THEN 'OBJECTIVE_SATISFIED' ELSE 'MISSING_EVIDENCE' END AS reason, round((n - failed) / n, 3) AS task_progress, round(coalesce(found / nullif(found + gaps, 0), 0.0), 3)::DOUBLE AS gap_progress FROM r""",
    "registry_coverage": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_cases, strftime(max(o_orderdate), '%Y-%m-%d') AS newest, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
    "latest_cases": f"SELECT {_PICK(CURRENCY, 'o_custkey')} AS tenant, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey DESC)::INTEGER AS place FROM orders QUALIFY place <= 100",
    "phase_domains": "SELECT user_id, CASE event_type WHEN 'view' THEN 'web' WHEN 'click' THEN 'web' WHEN 'signup' THEN 'identity' WHEN 'purchase' THEN 'finance' ELSE 'general' END AS domain, count(DISTINCT event_type) AS n_targets FROM events GROUP BY 1, 2",
}
