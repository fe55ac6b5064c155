"""Queries over documents, pages and conversations: independence, language, extraction, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents
from ..sources.shared import tabled
from ..sources.tables import read


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def doc_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts with an eight-word Jaccard of 0.55 or more."""
    bodies = tabled(documents.texts(docs(spark, sf_dir)))
    pairs = documents.similar_texts(bodies, 0.55)
    return pairs.select("doc_a", "doc_b", F.round("jaccard", 6).alias("jaccard"))


def doc_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.doc_clusters(docs(spark, sf_dir))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("g")).select("doc_id", "g.language", "g.confidence", "g.script")


def literal_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(T.literals(F.col("text"))).alias("x")).select("doc_id", "x.kind", "x.value")


def secret_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docs(spark, sf_dir).select("doc_id", T.masking(F.coalesce("text", F.lit(""))).alias("m"))
    return found.select("doc_id", F.size("m.found").alias("n_found"), F.sha2("m.text", 256).alias("masked_sha256"))


def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = T.injection_flags(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(flags, ",").alias("flags"), T.injection_risk(flags).alias("risk"))


def story_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = docs(spark, sf_dir).select("doc_id", T.title_key(F.substring_index("text", "\n", 1)).alias("story_key"), F.col("source").alias("publisher"))
    return documents.story_clusters(items)


def html_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, visible characters and links of each page, scripts and styles left out."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.length(text).alias("text_chars"), F.regexp_count(html, F.lit(r"(?i)<a[ \t\r\n][^>]*href=")).alias("link_count"))


def url_host_input_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.input_kind(F.col("url")).alias("input_kind"), T.input_kind(T.host(F.col("url"))).alias("host_kind"))


def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by script in each document, and the script with most."""
    spans = {"Latin": "A-Za-zÀ-ſ", "Cyrillic": "Ѐ-ӿ", "Greek": "Ͱ-Ͽ", "Han": "一-鿿"}
    text = F.coalesce("text", F.lit(""))
    rows = docs(spark, sf_dir).select("doc_id", *[T.in_span(text, v).alias(k.lower()) for k, v in spans.items()])
    best = F.array_max(F.array(*[F.struct(F.col(k.lower()).alias("n"), F.lit(k).alias("script")) for k in spans]))
    return rows.select("*", F.when(best["n"] > 0, best["script"]).alias("dominant"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, characters and distinct roles of each conversation."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


QUERIES = {f.__name__: f for f in (doc_shingle_jaccard, doc_clusters, language_id, literal_extraction, secret_masking, injection_scan, story_clusters, html_profile, url_host_input_kind, script_counts, conversation_turns)}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[a-zA-ZÀ-ſ]+')"
_RATES = ", ".join(f"len(list_filter(w, lambda x: list_contains({stop.split()}, x))) / len(w) AS {name}" for name, stop in T.STOPWORDS.items())
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(utm_[a-z]+=[^&\\s]+|ref(errer)?=[^&\\s]+)', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_SETS = f"""WITH RECURSIVE n AS (SELECT doc_id, {_NORM} AS body FROM documents), reps AS (SELECT min(doc_id) AS doc_id, body FROM n GROUP BY body HAVING body <> ''),
    w AS (SELECT doc_id, string_split(body, ' ') AS w FROM reps),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 8 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')) END) AS s FROM w),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), often AS (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1), live AS (SELECT sh.* FROM sh JOIN often USING (s)),
    shared AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM live a JOIN live b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    pairs AS (SELECT doc_a, doc_b, k / (x.n + y.n - k) AS jaccard FROM shared JOIN size x ON doc_a = x.doc_id JOIN size y ON doc_b = y.doc_id) """
_SPANS = {"latin": "A-Za-zÀ-ſ", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "han": "一-鿿"}
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _kind(v: str) -> str:
    bare = f"split_part(string_split({v}, '/')[-1], ':', 1)"
    return f"""CASE WHEN trim({v}) = '' THEN 'query' WHEN regexp_matches({v}, '(?i)^https?://[^/?#\\s]+') THEN 'url' WHEN regexp_matches({v}, '^{_OCTET}(\\.{_OCTET}){{3}}$') THEN 'ip_address'
        WHEN regexp_matches({v}, '(?i)^CVE-[0-9]{{4}}-[0-9]{{4,7}}$') THEN 'cve' WHEN regexp_matches({v}, '(?i)^([0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}})$') THEN 'hash'
        WHEN regexp_matches(lower({bare}), '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,63}}$') AND length({bare}) <= 253 THEN 'domain' WHEN regexp_matches({v}, '^@?[A-Za-z0-9_.-]{{1,80}}$') THEN 'username' ELSE 'query' END"""


# the patterns once more, by hand
_SECRETS = (
    r"(?i)(password|passwd|pass)\s*[:=]\s*\S+", r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*\S+", r"(?i)session[_-]?cookie\s*[:=]\s*\S+",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", r"\b[0-9a-fA-F]{32,64}:[^:\s]{4,}\b",
)
_MASKING = ", ".join(
    f"""x{k} AS (SELECT *, regexp_extract_all(text, '{p}') AS found, regexp_split_to_array(text, '{p}') AS own FROM t{k}),
    t{k + 1} AS (SELECT doc_id, own[1] || coalesce(array_to_string(list_transform(found, lambda x, i: left(x, 8) || '…[MASKED]' || own[i + 1]), ''), '') AS text, n + len(found) AS n FROM x{k})"""
    for k, p in enumerate(_SECRETS)
)
_HOST = "CASE WHEN regexp_extract(url, '^https?://([^/]+)', 1) <> '' THEN regexp_extract(url, '^https?://([^/]+)', 1) ELSE coalesce(url, '') END"
ORACLES = {
    "doc_shingle_jaccard": f"{_SETS} SELECT doc_a, doc_b, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= 0.55",
    "doc_clusters": f"""{_SETS}, near AS (SELECT doc_a AS a, doc_b AS b FROM pairs WHERE jaccard >= 0.85 UNION SELECT doc_b, doc_a FROM pairs WHERE jaccard >= 0.85),
        first AS (SELECT body, min(doc_id) AS rep FROM n GROUP BY body), r AS (SELECT rep AS a, rep AS b FROM first UNION SELECT r.a, near.b FROM r JOIN near ON r.b = near.a), c AS (SELECT a, min(b) AS cluster_id FROM r GROUP BY 1)
        SELECT n.doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM n JOIN first USING (body) JOIN c ON rep = a""",
    "language_id": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS body, list_transform({_WORDS}[1:5000], lambda x: lower(x)) AS w FROM documents), s AS (SELECT *, {_RATES} FROM t),
        b AS (SELECT *, list_sort([{{'r': en, 'k': 7, 'n': 'en'}}, {{'r': es, 'k': 6, 'n': 'es'}}, {{'r': fr, 'k': 5, 'n': 'fr'}}, {{'r': de, 'k': 4, 'n': 'de'}}, {{'r': pt, 'k': 3, 'n': 'pt'}}, {{'r': it, 'k': 2, 'n': 'it'}}, {{'r': nl, 'k': 1, 'n': 'nl'}}], 'DESC') AS o FROM s)
        SELECT doc_id, CASE WHEN trim(body) = '' THEN 'und' WHEN len(w) < 8 OR o[1].r < 0.03 THEN 'en' ELSE o[1].n END AS language,
        round(CASE WHEN trim(body) = '' THEN 0.0 WHEN len(w) < 8 THEN 0.3 WHEN o[1].r < 0.03 THEN 0.25 ELSE least(0.95, o[1].r * 3 + o[1].r - o[2].r) END::DOUBLE, 6) AS confidence, CASE WHEN trim(body) = '' THEN 'unknown' ELSE 'Latin' END AS script FROM b""",
    "literal_extraction": f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, 'https?://[^\\s"''<>)\\]]+', ' ', 'g') AS rest FROM documents)
        SELECT DISTINCT doc_id, 'url' AS kind, unnest(regexp_extract_all(text, 'https?://[^\\s"''<>)\\]]+')) AS value FROM t
        {" ".join(f"UNION SELECT doc_id, '{k}', unnest(regexp_extract_all(rest, '{p}')) FROM t" for k, p in T.LITERALS.items() if k != "url")}""",
    "secret_masking": f"""WITH t0 AS (SELECT doc_id, coalesce(text, '') AS text, 0 AS n FROM documents), {_MASKING}
        SELECT doc_id, n::INTEGER AS n_found, sha256(text) AS masked_sha256 FROM t{len(_SECRETS)}""",
    "injection_scan": f"""WITH f AS (SELECT conv_id, turn, list_filter([{", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in T.INJECTIONS.items())}], lambda x: x IS NOT NULL) AS flags FROM conversations)
        SELECT conv_id, turn, coalesce(array_to_string(flags, ','), '') AS flags, CASE WHEN len(flags) = 0 THEN 'CLEAN' WHEN list_has_any(flags, {list(T.HOSTILE)}) THEN 'HOSTILE' ELSE 'SUSPICIOUS' END AS risk FROM f""",
    "story_clusters": r"""SELECT left(trim(regexp_replace(regexp_replace(lower(coalesce(split_part(text, chr(10), 1), '')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')), 80) AS story_key,
        min(doc_id) AS canonical_doc, count(*) AS n_copies, greatest(1, count(DISTINCT source)) AS n_publishers FROM documents GROUP BY 1""",
    "html_profile": r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
        length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')))::INTEGER AS text_chars,
        len(regexp_extract_all(html, '(?i)<a[ \t\r\n][^>]*href='))::INTEGER AS link_count FROM pages""",
    "url_host_input_kind": f"WITH p AS (SELECT page_id, url, {_HOST} AS host FROM pages) SELECT page_id, host, {_kind('url')} AS input_kind, {_kind('host')} AS host_kind FROM p",
    "script_counts": f"""WITH c AS (SELECT doc_id, {", ".join(f"length(regexp_replace(coalesce(text, ''), '[^{v}]', '', 'g'))::INTEGER AS {k}" for k, v in _SPANS.items())} FROM documents)
        SELECT *, CASE WHEN greatest(latin, cyrillic, greek, han) > 0 THEN list_sort([{", ".join(f"{{'n': {k}, 's': '{k.capitalize()}'}}" for k in _SPANS)}], 'DESC')[1].s END AS dominant FROM c""",
    "conversation_turns": "SELECT conv_id, count(*) AS turns, sum(length(coalesce(text, '')))::BIGINT AS chars, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1",
}
