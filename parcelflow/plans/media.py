"""Pictures that adverts bring, stored once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media
from ..sources.domain import PHASH_SQL, changes, picture_hashes
from .registry import book

QUERIES, SQL, query = book()


def _pictures(spark, sf_dir):
    """A picture for each event: that of its listing, of which some bits change with the event; its content goes by listing and key."""
    c = changes(spark, sf_dir)
    key, bits = F.pmod("k", F.lit(36)), F.pmod("k", F.lit(12))
    seen = c.join(picture_hashes(spark, sf_dir).withColumnRenamed("vec_id", "listing_id"), "listing_id")
    flips = F.expr("shiftleft(1L, cast(pmod(k, 12) as int)) - 1")
    known = F.when(bits != 7, F.col("phash").bitwiseXOR(flips))
    return seen.select("event_id", "ts", F.sha2(F.concat_ws("|", "listing_id", key), 256).alias("sha"), known.alias("phash"))


@query(
    "ER-28_nearest_media",
    PHASH_SQL.join(("WITH RECURSIVE ", ", "))
    + """e AS (SELECT event_id, ts, user_id AS listing_id, (props::JSON ->> '$.k')::INT AS k FROM events),
s AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, sha256(listing_id || '|' || (k % 36)) AS sha, CASE WHEN k % 12 <> 7 THEN xor(phash, (1::UBIGINT << (k % 12)) - 1) END AS phash FROM e JOIN picture ON vec_id = listing_id),
a AS (SELECT sha, min(pos) AS pos, arg_min(phash, pos) AS phash FROM s GROUP BY sha),
h AS MATERIALIZED (SELECT phash, min(pos) AS pos, arg_min(sha, pos) AS head FROM a WHERE phash IS NOT NULL GROUP BY phash),
n AS MATERIALIZED (SELECT x.phash, y.phash AS parent, bit_count(xor(x.phash, y.phash)) AS bits FROM h x JOIN h y ON y.pos < x.pos AND bit_count(xor(x.phash, y.phash)) <= 8 QUALIFY row_number() OVER (PARTITION BY x.phash ORDER BY bits, y.pos) = 1),
r AS (SELECT phash AS root, phash FROM h WHERE phash NOT IN (SELECT phash FROM n) UNION ALL SELECT r.root, n.phash FROM r JOIN n ON n.parent = r.phash),
o AS (SELECT a.sha, a.pos, CASE WHEN a.sha <> h.head THEN 0 ELSE n.bits END AS bits, coalesce(t.head, a.sha) AS asset FROM a LEFT JOIN h USING (phash) LEFT JOIN n USING (phash) LEFT JOIN r USING (phash) LEFT JOIN h t ON t.phash = r.root)
SELECT event_id, asset, CASE WHEN s.pos <> o.pos THEN 'exact' WHEN bits IS NOT NULL THEN 'near' END AS reused, CASE WHEN s.pos = o.pos THEN bits END::INT AS bits FROM s JOIN o USING (sha)""",
)
def nearest_media(spark, sf_dir):
    """Where each picture is stored: content that is there already, then the place of the nearest earlier picture within eight bits, else its own."""
    pictures = _pictures(spark, sf_dir)
    return media.place(pictures, "sha", "phash", F.struct("ts", "event_id")).select("event_id", "asset", "reused", "bits")
