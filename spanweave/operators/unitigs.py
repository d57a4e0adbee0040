"""Unitigs of the de Bruijn graph of both strands, as pieces of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.sequences import revcomp
from spanweave.operators.kmers import kmer_counts
from spanweave.session import materialize


def _ranked(links: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """``id, head, pos`` of what follows a head, by pointer doubling along links (a, b); and ``id, low`` of what still
    has no head after 2**rounds steps, the vertices of circles, with the least id of their circle."""
    walk = materialize(links.select(F.col("b").alias("id"), F.col("a").alias("up"), F.lit(1).cast("long").alias("pos"), F.least("a", "b").alias("low"), F.lit(True).alias("moved")), "unitig-walk")
    for _ in range(rounds + 1):
        far = walk.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"), F.col("low").alias("low2"))
        walk = materialize(walk.join(far, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("pos") + F.coalesce("pos2", F.lit(0))).alias("pos"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("up2").isNotNull().alias("moved")), "unitig-walk")
        if not walk.where("moved").take(1):
            break
    return walk.where(~F.col("moved")).select("id", F.col("up").alias("head"), "pos"), walk.where("moved").select("id", "low")


def unitigs(seqs: DataFrame, k: int, least: int = 1, width: int = 60) -> DataFrame:
    """``unitig, piece, text``: the unitigs of the sequences' k-mers that are seen at least ``least`` times on either
    strand, in pieces of ``width`` characters (from 0; the last is shorter); ``unitig`` is its first k-mer.

    A k-mer on one strand is followed by another if that is the only one that begins with its last k - 1 characters, and
    it the only one that ends with them. Each k-mer is in one unitig, on one strand: a unitig and its reverse complement
    are the same, the one whose first k-mer is smaller is given. A circle begins at its smallest k-mer. A step from a
    k-mer to its own reverse complement is never taken. ``k`` must be odd, so that no k-mer is its own reverse complement.

    Unitigs are ranked by pointer doubling, in a logarithmic number of rounds, and no unitig has to fit a task. Sequences
    shorter than k, null or empty ones and an empty table give nothing; characters other than A, C, G and T are taken as
    their own complements.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    found = kmer_counts(seqs.where("seq IS NOT NULL"), k).where(F.col("n") >= least).select("kmer", F.monotonically_increasing_id().alias("n"))
    found = materialize(found, "unitig-kmers")
    # strand 0 as it is, strand 1 reversed; a mirror is the number with its last bit turned
    both = found.select((F.col("n") * 2).alias("id"), "kmer").union(found.select(F.col("n") * 2 + 1, revcomp(F.col("kmer"))))
    both = materialize(both, "unitig-strands")
    end, start = F.substring("kmer", 2, k - 1), F.substring("kmer", 1, k - 1)
    out = both.groupBy(end.alias("mid")).agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n = 1").select("mid", "a")
    into = both.groupBy(start.alias("mid")).agg(F.count("*").alias("n"), F.min("id").alias("b")).where("n = 1").select("mid", "b")
    links = materialize(out.join(into, "mid").where(F.col("b") != F.col("a").bitwiseXOR(F.lit(1))).select("a", "b"), "unitig-links")
    line, ring = _ranked(links, max(1, links.count().bit_length()))
    ring = materialize(ring.join(both, "id"), "unitig-circles")
    if ring.take(1):
        first = ring.groupBy("low").agg(F.min_by("id", "kmer").alias("b"), F.min("kmer").alias("kmer"), F.min(revcomp(F.col("kmer"))).alias("mirror"))
        first = materialize(first, "unitig-circles")
        on = links.join(ring.select(F.col("id").alias("b")), "b", "left_semi")
        opened, _ = _ranked(on.join(first.select("b"), "b", "left_anti"), max(1, links.count().bit_length()))
        line = line.join(ring.select("id"), "id", "left_anti").union(opened)
        kept_rings = first.where("kmer < mirror").select(F.col("b").alias("head"))
    else:
        kept_rings = ring.select(F.col("id").alias("head")).limit(0)
    line = materialize(line, "unitig-places")
    alone = both.select("id").join(line.select("id"), "id", "left_anti").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("pos"))
    places = materialize(line.union(alone), "unitig-places")
    name = both.select(F.col("id").alias("head"), F.col("kmer").alias("unitig"))
    tails = places.groupBy("head").agg(F.max_by("id", "pos").alias("tail")).join(both.select(F.col("id").alias("tail"), F.col("kmer").alias("last")), "tail").join(name, "head")
    circles = ring.select(F.col("id").alias("head"))
    kept = tails.join(circles, "head", "left_anti").where(F.col("unitig") < revcomp(F.col("last"))).select("head", "unitig").union(name.join(kept_rings, "head"))
    rows = places.join(kept, "head").join(both, "id").select("unitig", "pos", "kmer")
    begin = rows.where("pos = 0").select("unitig", F.posexplode(F.split("kmer", "")).alias("at", "c")).where("c <> ''").select("unitig", F.col("at").cast("long").alias("at"), "c")
    chars = begin.union(rows.where("pos > 0").select("unitig", F.col("pos") + k - 1, F.substring("kmer", k, 1)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda x: x["c"]), "")
    return chars.groupBy("unitig", F.expr(f"at div {width}").alias("piece")).agg(text.alias("text"))
