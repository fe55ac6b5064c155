"""Captured responses of public sources as observations: target, body -> subject, predicate, value.

Bodies are what a fetch stored; nothing here reaches a network. Bodies that don't parse give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows(responses: DataFrame, predicate: str | Column, values: Column) -> DataFrame:
    """One observation for each value of an array column; nulls and blanks go."""
    name = F.lit(predicate) if isinstance(predicate, str) else predicate
    out = responses.select(F.col("target").alias("subject"), name.alias("predicate"), F.explode(values).alias("value"))
    return out.where(F.trim("value") != "")


def parsed(responses: DataFrame, schema: str) -> DataFrame:
    return responses.withColumn("r", F.from_json("body", schema))


def dns(responses: DataFrame) -> DataFrame:
    """{"qname", "rtype", "records"}: one row a record, dots at the end dropped."""
    found = parsed(responses, "rtype string, records array<string>")
    return rows(found, F.concat(F.lit("dns."), F.lower("r.rtype")), F.transform("r.records", lambda v: F.regexp_replace(v, r"\.+$", "")))


def registration(responses: DataFrame) -> DataFrame:
    """RDAP: registrar (the name in its card, else its handle), status, events, name servers."""
    found = parsed(responses, "entities array<struct<roles:array<string>,handle:string,vcardArray:array<string>>>, status array<string>, events array<struct<eventAction:string,eventDate:string>>, nameservers array<struct<ldhName:string>>")
    registrars = F.filter("r.entities", lambda e: F.exists(e["roles"], lambda x: F.lower(x) == "registrar"))
    card = lambda e: F.get(F.filter(F.from_json(F.get(e["vcardArray"], 1), "array<array<string>>"), lambda f: F.get(f, 0) == "fn"), 0)
    named = rows(found, "registrar", F.transform(registrars, lambda e: F.coalesce(F.get(card(e), 3), e["handle"])))
    event = found.select(F.col("target").alias("subject"), F.explode("r.events").alias("e")).select("subject", F.concat(F.lit("registration.event."), "e.eventAction").alias("predicate"), F.col("e.eventDate").alias("value"))
    listed = lambda name, values: rows(found, name, F.array(F.when(F.size(values) > 0, F.array_join(values, "|"))))
    servers = F.transform("r.nameservers", lambda n: F.regexp_replace(n["ldhName"], r"\.+$", ""))
    return named.union(listed("registration.status", F.col("r.status"))).union(event).union(listed("domain.nameserver", servers))


def certificate_names(responses: DataFrame) -> DataFrame:
    """Certificate transparency: the distinct names seen, wildcards stripped, other than the target itself."""
    found = parsed(responses, "list array<struct<name_value:string>>").withColumn("r", F.from_json("body", "array<struct<name_value:string>>"))
    names = F.flatten(F.transform("r", lambda c: F.split(c["name_value"], r"[,\n]")))
    cleaned = F.transform(names, lambda n: F.regexp_replace(F.lower(F.trim(n)), r"^[*.]+", ""))
    return rows(found, "domain.subdomain_seen_in_ct", F.array_sort(F.array_distinct(cleaned))).where("value <> subject")


def address_facts(responses: DataFrame) -> DataFrame:
    """IP geolocation: address, AS number, connection, organisation, country, location."""
    found = parsed(responses, "success boolean, ip string, asn string, connection_type string, org string, isp string, country_code string, country string, lat double, lng double").where("coalesce(r.success, true)")
    values = {
        "ip.address": F.col("r.ip"), "ip.asn": F.when(F.upper("r.asn").startswith("AS"), F.col("r.asn")), "ip.connection_type": F.col("r.connection_type"), "ip.organization": F.coalesce(F.nullif("r.org", F.lit("")), "r.isp"),
        "ip.country": F.coalesce(F.nullif("r.country_code", F.lit("")), "r.country"), "ip.location": F.concat_ws(",", F.col("r.lat").cast("string"), F.col("r.lng").cast("string")),
    }
    pairs = found.select(F.col("target").alias("subject"), F.explode(F.array(*[F.struct(F.lit(k).alias("predicate"), v.alias("value")) for k, v in values.items()])).alias("p"))
    return pairs.select("subject", "p.predicate", "p.value").where("trim(value) <> ''")


def snapshots(responses: DataFrame) -> DataFrame:
    """Archive index: a header row, then rows; timestamp and original by their place in the header."""
    table = F.from_json("body", "array<array<string>>")
    found = responses.withColumn("head", F.get(table, 0)).withColumn("lines", F.filter(table, lambda _, k: k > 0))
    at = lambda row, name, other: F.get(row, F.coalesce(F.nullif(F.array_position("head", name), F.lit(0)) - 1, F.lit(other)).cast("int"))
    return rows(found, "archive.snapshot", F.transform("lines", lambda row: F.concat_ws(" ", at(row, "timestamp", 1), at(row, "original", 2))))


def reverse_names(responses: DataFrame) -> DataFrame:
    """Text of one host name a line."""
    fine = responses.where(~F.trim("body").startswith("error"))
    return rows(fine, "ptr.hostname", F.transform(F.split("body", r"[\r\n]+"), lambda x: F.trim(x)))


def vulnerabilities(responses: DataFrame) -> DataFrame:
    """Advisories of a package with the first CVE alias."""
    found = parsed(responses, "vulns array<struct<id:string,aliases:array<string>,summary:string>>")
    cve = lambda v: F.get(F.filter(v["aliases"], lambda a: F.upper(a).startswith("CVE-")), 0)
    return rows(found, "package.vulnerability", F.transform("r.vulns", lambda v: F.to_json(F.struct(v["id"].alias("osv_id"), cve(v).alias("cve"), F.left(v["summary"], F.lit(300)).alias("summary")))))


def transactions(responses: DataFrame, most: int = 25, addresses: int = 10) -> DataFrame:
    """Chain transactions: id, and the distinct sorted input and output addresses."""
    script = "struct<scriptpubkey_address:string>"
    found = responses.withColumn("r", F.from_json("body", f"array<struct<txid:string,vin:array<struct<prevout:{script}>>,vout:array<{script}>>>"))
    ends = lambda a: F.slice(F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull()))), 1, addresses)
    row = lambda t: F.to_json(F.struct(t["txid"].alias("txid"), ends(F.transform(t["vin"], lambda v: v["prevout"]["scriptpubkey_address"])).alias("inputs"), ends(F.transform(t["vout"], lambda o: o["scriptpubkey_address"])).alias("outputs")))
    return rows(found, "wallet.transaction", F.transform(F.slice("r", 1, most), row))


def feed_items(responses: DataFrame, most: int = 40) -> DataFrame:
    """RSS: title, link and date of each item."""
    found = responses.withColumn("r", F.from_xml("body", "channel struct<item:array<struct<title:string,link:string,pubDate:string>>>"))
    items = F.slice(F.col("r.channel.item"), 1, most)
    return rows(found, "feed.item", F.transform(items, lambda i: F.to_json(F.struct(i["title"].alias("title"), i["link"].alias("link"), i["pubDate"].alias("published")))))
