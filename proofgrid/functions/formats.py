"""Columns about formats: tags of values, roles of column names, media types, refined formats, chain addresses, safe URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Hex digits of the hashes.
HASH_DIGITS = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Patterns of tags that stand by themselves.
TAGS = {
    "integer": r"^[0-9]+$",
    "float": r"^(-[0-9]+(\.[0-9]+)?|[0-9]+\.[0-9]+)$",
    "maybe_coordinate": r"^-?[0-9]{1,3}\.[0-9]+$",
    "timestamp_epoch": r"^(1[5-9]|2[01])[0-9]{8}$",
    "timestamp_epoch_ms": r"^(1[5-9]|2[01])[0-9]{11}$",
    "maybe_phone": r"^[1-5][0-9]{6,}$",
    "timestamp": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{10}|[0-9]{13})$",
    "cve": r"(?i)^CVE-[0-9]{4}-[0-9]{4,7}$",
    "eth_address": r"^0x[0-9a-fA-F]{40}$",
    "crypto_address": r"^((bc1|[13])[a-zA-HJ-NP-Z0-9]{25,62}|0x[0-9a-fA-F]{40})$",
    "hash": r"^([0-9a-fA-F]{16}|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})$",
    "identifier_like": r"^[A-Za-z][A-Za-z_.-][A-Za-z0-9_.-]{0,29}$",
    "non_ascii": r"[^\x00-\x7F]",
}
# Patterns of which the first that fits counts.
FIRST_OF = {
    "email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "url": r"(?i)^https?://",
    "domain": r"(?i)^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}$",
    "ip_address": rf"^{_OCTET}(\.{_OCTET}){{3}}$",
}
# What a column's name says of its values; the first that fits counts.
ROLES = (
    (r"(e[-_]?mail|email_addr)", "email"), (r"(phone|mobile|tel(_?no)?)", "phone"), (r"^(ip|src_ip|dst_ip|source_ip|dest_ip|client_ip|server_ip)$", "ip_address"), (r"(lat(itude)?|y_coord|geo_lat)", "latitude"), (r"(lon(gitude)?|x_coord|geo_lon)", "longitude"), (r"(url|href|link|uri)", "url"),
    (r"(domain|host(name)?)", "domain"), (r"(hash|md5|sha1|sha256|checksum)", "hash"), (r"(wallet|address_btc|btc_addr|eth_addr)", "crypto_address"), (r"(user(name|_id)|handle|nick)", "username"), (r"(first[-_ ]?name|given)", "person_first_name"), (r"(last[-_ ]?name|surname|family)", "person_last_name"),
    (r"(full[-_ ]?name|display[-_ ]?name|^name$|contact)", "person_name"), (r"(company|org(anization)?|employer|^firm)", "organization"), (r"^(time|date|timestamp|seen_at|created|updated|_at$|ts)", "timestamp"), (r"(cve|vuln)", "cve"), (r"(country|city|location|address|geo)", "location"),
    (r"(file_hash|filename|path)", "file"), (r"(amount|price|total|currency)", "currency"),
)
# Media types by extension, the common ones, and other spellings of a type.
MEDIA = {
    "txt": "text/plain", "md": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson", "yaml": "application/yaml", "xml": "application/xml", "html": "text/html", "csv": "text/csv", "tsv": "text/tab-separated-values", "pdf": "application/pdf", "zip": "application/zip",
    "gz": "application/gzip", "bz2": "application/x-bzip2", "xz": "application/x-xz", "parquet": "application/vnd.apache.parquet", "jpg": "image/jpeg", "png": "image/png", "mp4": "video/mp4", "mp3": "audio/mpeg", "warc": "application/warc", "geojson": "application/geo+json", "kml": "application/vnd.google-earth.kml+xml",
}
DOUBLE = {"warc.gz": "application/warc-gzip", "cdx.json": "application/vnd.cyclonedx+json", "tar.gz": "application/gzip", "tar.bz2": "application/x-bzip2", "tar.xz": "application/x-xz"}
SPELLINGS = {"text/yaml": "application/yaml", "application/x-yaml": "application/yaml", "text/json": "application/json", "application/x-sqlite3": "application/vnd.sqlite3", "text/xml": "application/xml"}
SHARED_SUBTYPES = ("xml", "json", "zip", "octet-stream", "plain")
# Formats that a name's format may turn out to be, and formats that pass for each other.
MAY_BE = {"zip": ("docx", "xlsx", "pptx", "odt", "epub", "kmz", "wacz"), "json": ("jsonl", "stix2", "geojson", "sarif", "har"), "gzip": ("tar.gz",), "text": ("markdown", "log", "csv", "tsv", "yaml", "toml", "syslog", "diff"), "xml": ("graphml", "gexf", "kml", "gpx", "rdf", "osm", "html"), "sqlite": ("gpkg", "mbtiles")}
ALIKE = (("csv", "tsv", "psv", "xlsx", "xls", "ods"), ("pdf", "docx", "doc", "odt", "rtf", "epub"), ("jpeg", "png", "gif", "webp", "tiff", "bmp", "svg"), ("mp3", "wav", "flac", "ogg", "m4a"), ("mp4", "mov", "avi", "mkv", "webm"))
XML_ROOTS = (("<graphml", "graphml"), ("<gexf", "gexf"), ("<kml", "kml"), ("<gpx", "gpx"), ("<rdf", "rdf"), ("rdf:rdf", "rdf"), ("<html", "html"), ("<!doctype html", "html"), ("<osm", "osm"))


def value_tags(value: Column) -> Column:
    """The tags that fit one value, in order; a blank one is empty."""
    def of(v: Column) -> Column:
        digits = F.when(v.rlike("^[0-9a-fA-F]+$"), F.try_element_at(F.create_map(*[x for n, name in HASH_DIGITS.items() for x in (F.lit(n), F.lit(f"hash_{name}"))]), F.length(v)))
        first = F.coalesce(*[F.when(v.rlike(p), F.lit(t)) for t, p in FIRST_OF.items()])
        found = F.filter(F.array(*[F.when(v.rlike(p), F.lit(t)) for t, p in TAGS.items()], first, digits), lambda t: t.isNotNull())
        return F.when(v == "", F.array(F.lit("empty"))).otherwise(found)

    return bound(F.trim(F.coalesce(value, F.lit(""))), of)


def name_role(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), F.lit(role)) for p, role in ROLES])


def media_of_name(name: Column) -> Column:
    """The media type that a file name suggests, double extensions first; null for names without one."""
    low = F.lower(name)
    double = [F.when(low.endswith(f".{ext}"), F.lit(kind)) for ext, kind in DOUBLE.items()]
    table = F.create_map(*[x for ext, kind in MEDIA.items() for x in (F.lit(ext), F.lit(kind))])
    return F.coalesce(*double, F.try_element_at(table, F.regexp_extract(low, r"^.+\.([a-z0-9]+)$", 1)))


def normal_media(value: Column) -> Column:
    """Lower case, without parameters, one spelling for each type; null for blanks."""
    bare = F.nullif(F.lower(F.trim(F.substring_index(value, ";", 1))), F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SPELLINGS.items() for x in (F.lit(k), F.lit(v))]), bare), bare)


def media_family(a: Column, b: Column) -> Column:
    """Whether two media types are of one family, and one of them is a container or plain form of it."""
    sub = lambda c: F.substring_index(c, "/", -1)
    return (F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)) & (sub(a).isin(*SHARED_SUBTYPES) | sub(b).isin(*SHARED_SUBTYPES))


def formats_compatible(named: Column, found: Column) -> Column:
    """Whether a content's format goes with the one its name suggests."""
    groups = [named.isin(*g) & found.isin(*g) for g in ALIKE]
    turns = [(named == k) & found.isin(*v) for k, v in MAY_BE.items()]
    test = named == found
    for t in (*groups, *turns):
        test = test | t
    return test


def refined_format(kind: Column, text: Column) -> Column:
    """json and xml by what they hold: geojson, stix2, sarif; graphml, gexf, kml, gpx, rdf, html, osm."""
    at = lambda path: F.get_json_object(text, path)
    json = F.when(at("$.type") == "FeatureCollection", "geojson").when(at("$.spec_version").startswith("2."), "stix2").when(at("$.Version").isNotNull() & at("$.Runs").isNotNull(), "sarif")
    head = F.lower(F.left(text, F.lit(4096)))
    xml = F.coalesce(*[F.when(head.contains(mark), F.lit(name)) for mark, name in XML_ROOTS])
    return F.coalesce(F.when(kind == "json", json), F.when(kind == "xml", xml), kind)


def looks_binary(content: Column) -> Column:
    """Whether the first 8 KiB hold a zero byte."""
    return F.locate("\x00", F.decode(F.substring(content, 1, 8192), "ISO-8859-1")) > 0


def corroborated(a: Column, b: Column) -> Column:
    """Two independent confidences together, never above 0.99."""
    return F.least(F.lit(0.99), 1 - (1 - a) * (1 - b))


def chain_address(chain: Column, address: Column) -> Column:
    """What an address is worth on its chain."""
    bitcoin = address.rlike(r"^[13][a-km-zA-HJ-NP-Z1-9]{25,34}$|^(bc1|tb1)[acdefghjklmnpqrstuvwxyz02-9]{11,87}$")
    verdict = lambda ok, name: F.when(ok, f"valid_{name}").otherwise(f"invalid_{name}")
    return F.when(chain == "bitcoin", verdict(bitcoin, "bitcoin")).when(chain == "ethereum", verdict(address.rlike(r"^0x[0-9a-fA-F]{40}$"), "ethereum")).otherwise(F.concat(F.lit("unsupported_chain:"), chain))


def valid_transaction_hash(value: Column) -> Column:
    return value.rlike(r"^(0x)?[0-9a-fA-F]{64}$")


def valid_identifier(value: Column) -> Column:
    """A kind, an underscore and at least eight letters or digits."""
    return value.rlike(r"^[a-z]{2,16}_[0-9a-z]{8,}$")


def url_safety(url: Column) -> Column:
    """Empty where a URL may be fetched, else why not: scheme, host, private or reserved addresses. Names aren't resolved."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    private = r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(22[4-9]|2[3-5][0-9])\."
    numeric = host.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    local6 = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)\]$")
    return F.when(~scheme.isin("http", "https"), "scheme not allowed").when(host == "", "missing host").when((host == "localhost") | (numeric & host.rlike(private)) | local6, "private or reserved address").otherwise("")


def unwrapped(href: Column) -> Column:
    """The target of a search engine's redirect (its uddg parameter), or the link itself."""
    inner = F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1)
    return F.when(inner != "", F.coalesce(F.try_url_decode(inner), inner)).otherwise(href)


def claim_key(text: Column) -> Column:
    """Lower case letters and digits, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def year_window(text: Column) -> Column:
    """struct(first, last) of the years from 1900 to 2099 that a text names; null without any."""
    years = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)
    return bound(years, lambda y: F.when(F.size(y) > 0, F.struct(F.array_min(y).cast("int").alias("first"), F.array_max(y).cast("int").alias("last"))))
