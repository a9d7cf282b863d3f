"""Operators of the older engine, with its own masses and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.masses import LEGACY_RESIDUES, legacy_ion_mz, legacy_mass, ppm_to_da_abs
from ..functions.sequences import DISALLOWED, counted, digest_flags, kmer_overlap
from .extension import chunk_of, count_at_most, mass_before, offset_in, running_masses
from .keys import SPECTRUM
from .kmers import CHUNK
from .range_join import range_join


def legacy_precursors(spectra: DataFrame, decimals: int, num_peaks: int = 0, share: float = 0.0) -> DataFrame:
    """Spectra with ``peaks`` arrays to fragments: sample, scan, precursor_mz, precursor_charge, frag_id (place by m/z, from
    0), mz, abundance, rounded to some decimals. The num_peaks most intense peaks are kept, or else those of at least a
    share (over 1: percent) of the spectrum's intensity, or all. Without a selected ion the largest m/z counts as the
    precursor, with charge 1."""
    while share > 1:
        share /= 100
    most = F.array_max(F.transform("peaks", lambda p: p["mz"]))
    df = spectra.select(*SPECTRUM, F.coalesce("precursor_mz", most).alias("precursor_mz"), F.when(F.col("precursor_mz").isNull(), 1).otherwise(F.col("precursor_charge")).alias("precursor_charge"), "peaks")
    total = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"])
    order = F.array_sort(F.transform("peaks", lambda p: F.struct((-p["intensity"]).alias("down"), p["id"].alias("id"), p["mz"].alias("mz"))))
    kept = F.slice(order, 1, num_peaks) if num_peaks > 0 else F.filter(order, lambda p: -p["down"] >= share * total)
    by_mz = F.array_sort(F.transform(kept, lambda p: F.struct(p["mz"].alias("mz"), p["id"].alias("id"), (-p["down"]).alias("abundance"))))
    df = df.select(*SPECTRUM, F.round("precursor_mz", decimals).alias("precursor_mz"), "precursor_charge", F.posexplode(by_mz).alias("frag_id", "p"))
    return df.select(*SPECTRUM, "precursor_mz", "precursor_charge", "frag_id", F.round("p.mz", decimals).alias("mz"), F.round("p.abundance", decimals).alias("abundance"))


def legacy_fragment_filter(fragments: DataFrame, least: float) -> DataFrame:
    """Fragments of at least some abundance. The older engine takes its ppm tolerance for that bound."""
    return fragments.where(F.col("abundance") >= least)


def legacy_kmers(proteins: DataFrame, max_k: int, left: list[str] | None = None, right: list[str] | None = None) -> DataFrame:
    """prot_id, kmer, start, end, ion_type, charge, mass: k-mers of 2..max_k that the digest rule lets stand as b or y.

    Proteins are cut into overlapping chunks with one letter more on either side, so that a row never carries a protein.
    """
    n = F.length("seq")
    df = proteins.select("prot_id", "seq", F.explode(counted(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("c"))
    before = F.when(F.col("c") > 0, F.substring("seq", F.col("c") * CHUNK, F.lit(1))).otherwise("")
    body, after = F.substring("seq", F.col("c") * CHUNK + 1, F.lit(CHUNK + max_k - 1)), F.substring("seq", (F.col("c") + 1) * CHUNK + max_k, F.lit(1))
    df = df.select("prot_id", (F.col("c") * CHUNK).alias("base"), before.alias("before"), body.alias("body"), after.alias("after"))
    starts = counted(F.lit(0), F.least(F.length("body"), F.lit(CHUNK)) - 1)
    words = F.transform(starts, lambda s: F.struct(
        (F.col("base") + s).alias("start"), F.substring("body", s + 1, F.lit(max_k)).alias("word"),
        F.when(s == 0, F.col("before")).otherwise(F.substring("body", s, F.lit(1))).alias("prior"),
        F.concat(F.substring("body", s + max_k + 1, F.lit(1)), F.when(s + max_k == F.length("body"), F.col("after")).otherwise("")).alias("next"),
    ))
    df = df.select("prot_id", F.inline(words)).select("*", F.explode(counted(F.lit(2), F.length("word"))).alias("k"))
    k, context = F.col("k"), F.concat("prior", "word", "next")
    first = F.length("prior")  # 0 at a protein's first letter
    b, y = digest_flags(context, first, first + k, left or ["-"], right or ["-"])
    kinds = F.filter(F.array(F.when(b, F.lit("b")), F.when(y, F.lit("y"))), lambda x: x.isNotNull())
    df = df.select("prot_id", F.left("word", k).alias("kmer"), "start", (F.col("start") + k).alias("end"), F.explode(kinds).alias("ion_type"))
    df = df.where(F.col("kmer") == F.translate("kmer", DISALLOWED, "")).withColumn("charge", F.explode(F.array(F.lit(1), F.lit(2))))
    return df.withColumn("mass", legacy_ion_mz(legacy_mass(F.col("kmer")), F.col("charge"), F.col("ion_type")))


def sequence_lookup(kmers: DataFrame, prot_id: int, start: int, end: int) -> DataFrame:
    """The k-mers of one place."""
    return kmers.where((F.col("prot_id") == prot_id) & (F.col("start") == start) & (F.col("end") == end))


def extensions_to_length(kmers: DataFrame, seed: DataFrame, dist: int, most: str = "precursor_mz") -> DataFrame:
    """seed (prot_id, start, end, precursor_mz) to the b k-mers of charge 2 with the same start that are dist - 1 letters
    longer and not heavier than the precursor."""
    k = kmers.where("charge = 2 and ion_type = 'b'").select("prot_id", F.col("kmer").alias("longer"), "start", F.col("end").alias("e"), "mass")
    s = seed.withColumn("e", F.col("end") + dist - 1)
    return s.join(k, ["prot_id", "start", "e"]).where(F.col("mass") <= F.col(most)).drop("e")


def count_ion_mass(kmers: DataFrame, mass: float, tolerance: float, ion_type: str) -> DataFrame:
    """n: k-mers of an ion type within a mass window."""
    return kmers.where((F.col("ion_type") == ion_type) & F.col("mass").between(mass - tolerance, mass + tolerance)).agg(F.count("*").alias("n"))


def legacy_mass_join(fragments: DataFrame, kmers: DataFrame, ppm: float = 10.0) -> DataFrame:
    """fragments (frag_id, mz, ...) to k-mers whose ion mass lies within ppm of the fragment; others are dropped."""
    tol = ppm_to_da_abs(ppm, F.col("mz"))
    spans = fragments.withColumn("lo", F.col("mz") - tol).withColumn("hi", F.col("mz") + tol)
    return range_join(kmers, spans, "mass", "lo", "hi", 0.1).drop("lo", "hi")


def legacy_clusters(matches: DataFrame) -> DataFrame:
    """Per precursor, protein and anchor: the longest k-mer (first place on ties) and the number of matches."""
    anchor = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    longest = F.max_by(F.struct("kmer", "start", "end", "kmer_mass"), F.struct(F.length("kmer"), -F.col("start")))
    df = matches.groupBy("prec_id", "precursor_mz", "prot_id", "ion_type", anchor.alias("anchor")).agg(longest.alias("l"), F.count("*").alias("score"))
    return df.select("prec_id", "precursor_mz", "prot_id", "ion_type", "anchor", "l.*", "score")


def legacy_extend(found: DataFrame, proteins: DataFrame) -> DataFrame:
    """Adds extension: residues next to the cluster while the sum of masses stays at most the precursor's m/z value.
    Letters BXUZOJ are skipped, others without a mass weigh nothing. The end is found by binary search in running masses."""
    units = {c: round(m * 10**6) for c, m in LEGACY_RESIDUES.items() if c not in DISALLOWED}
    reach = found.agg(F.max(F.floor(F.col("precursor_mz") / 57.0) + 1))
    table = running_masses(proteins, "prot_id", reach, units, other=0)
    # the rule decides between the neighbours of the bound in closed form
    near, fits = F.floor(F.col("precursor_mz") * 1e6).cast("long"), lambda m: m / 1e6 <= F.col("precursor_mz")
    heaviest = F.coalesce(*[F.when(fits(near + d), near + d) for d in (1, 0, -1)]) - F.round(F.col("kmer_mass") * 1e6).cast("long")
    kind, next_to = F.col("ion_type"), F.when(F.col("ion_type") == "b", F.col("end")).otherwise(F.col("start"))
    # a cluster at the protein's end meets no piece and has nothing to grow into
    df = found.withColumn("__most", heaviest).withColumn("chunk", chunk_of(kind, next_to)).join(table, ["prot_id", "ion_type", "chunk"], "left")
    at = offset_in(kind, next_to)
    n = F.when(F.col("__most") >= 0, count_at_most(F.col("masses"), mass_before(at) + F.col("__most")) - at).otherwise(0)
    grown = F.regexp_replace(F.substring("letters", at + 1, F.greatest(n, F.lit(0))), f"[{DISALLOWED}]", "")
    grown = F.coalesce(F.when(kind == "b", grown).otherwise(F.reverse(grown)), F.lit(""))
    return df.select(*[F.col(c) for c in found.columns], grown.alias("extension"))


def best_complement(found: DataFrame) -> DataFrame:
    """Each cluster with the opposite cluster of its precursor whose mass adds up to most without passing the
    precursor's m/z value. As-of: both sides are merged in order of mass, and the last opposite mass at or below what is
    left is carried forward, so no pairs are made. score and extension of both sides go along where the input has them."""
    facts = [c for c in ("prot_id", "anchor", "kmer", "kmer_mass", "score", "extension", "seq_length") if c in found.columns]
    own, none = F.struct(*facts), F.lit(None).cast(found.select(F.struct(*facts).alias("own")).schema["own"].dataType)
    kind, mass = F.col("ion_type"), F.col("kmer_mass")
    row = lambda t, at, probe, own, best: F.struct(t.alias("ion_type"), at.alias("at"), F.lit(probe).alias("probe"), own.alias("own"), best.alias("best"))
    me, other = row(kind, F.col("precursor_mz") - mass, 1, own, none), row(F.when(kind == "b", "y").otherwise("b"), mass, 0, none, own)
    both = found.select("prec_id", F.inline(F.array(me, other)))  # one pass over the clusters, dealt as they are
    # of equal masses the first cluster (least protein, anchor) wins: it comes last in this order
    w = W.partitionBy("prec_id", "ion_type").orderBy("at", "probe", F.desc("best.prot_id"), F.desc("best.anchor")).rowsBetween(W.unboundedPreceding, 0)
    df = both.withColumn("match", F.last("best", ignorenulls=True).over(w)).where("probe = 1 and match is not null and match.kmer_mass > 0")
    own = [F.col(f"own.{c}").alias(c) for c in facts if c != "kmer_mass"]
    return df.select("prec_id", "ion_type", *own, *[F.col(f"match.{c}").alias(f"other_{c}") for c in facts if c != "kmer_mass"])


def peptide_type(b_protein: Column, y_protein: Column) -> Column:
    """u: a side is missing, h: sides of two proteins, n: of one."""
    return F.when(b_protein.isNull() | y_protein.isNull(), "u").when(b_protein != y_protein, "h").otherwise("n")


def peptide_score(b_kmer: Column, y_kmer: Column, protein_length: Column) -> Column:
    """Letters of both k-mers over the length of the protein of the cluster that the pair was made for."""
    return (F.length(b_kmer) + F.length(y_kmer)) / protein_length


def aligned_peptides(pairs: DataFrame) -> DataFrame:
    """Pairs of best_complement over extended clusters (with score, extension and seq_length, the length of the cluster's
    protein) to peptides: peptide_type, left_prot_id, right_prot_id, sequence (b k-mer, its extension, y extension, y
    k-mer), b_score, y_score, total_score, length_score, the extensions, and the overlap of the k-mers."""
    is_b = F.col("ion_type") == "b"
    side = lambda c, b: F.when(is_b if b else ~is_b, F.col(c)).otherwise(F.col(f"other_{c}"))
    b, y, bx, yx = side("kmer", True), side("kmer", False), side("extension", True), side("extension", False)
    bp, yp, bs, ys = side("prot_id", True), side("prot_id", False), side("score", True), side("score", False)
    return pairs.select(
        "*", peptide_type(bp, yp).alias("peptide_type"), bp.alias("left_prot_id"), yp.alias("right_prot_id"), F.concat(b, bx, yx, y).alias("sequence"),
        bs.alias("b_score"), ys.alias("y_score"), (bs + ys).alias("total_score"), peptide_score(b, y, F.col("seq_length")).alias("length_score"),
        bx.alias("b_extension"), yx.alias("y_extension"), kmer_overlap(b, y).alias("overlap"),
    )


#: Fixed column names of the older engine's output, in order.
OUTPUT_COLUMNS = (
    "spectrum_id", "hybrid", "sequence", "total score", "#peaks/length", "total gaussian score", "total mass error", "precursor mass",
    "precursor charge", "left kmer", "right kmer", "b score", "y score", "prev aa", "next aa",
)


def legacy_output(peptides: DataFrame, names: DataFrame) -> DataFrame:
    """aligned_peptides (with precursor_mz, precursor_charge) as the 15 columns of the older engine's result table, texts
    only; lists are joined by /. names: prot_id, name. The mass error is not computed there and is 0."""
    left, right = (names.select(F.col("prot_id").alias(f"{s}_prot_id"), F.col("name").alias(f"{s}_name")) for s in ("left", "right"))
    df = peptides.join(left, "left_prot_id", "left").join(right, "right_prot_id", "left")
    letters = lambda c: F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), "/")
    n = F.length("sequence")
    cells = (
        F.col("prec_id"), F.col("peptide_type"), F.col("sequence"), F.col("total_score"),
        F.concat_ws("/", (F.col("total_score") * n).cast("string"), n.cast("string")), F.col("length_score"), F.lit(0), F.col("precursor_mz"),
        F.col("precursor_charge"), F.col("left_name"), F.col("right_name"), F.col("b_score"), F.col("y_score"), letters("b_extension"), letters("y_extension"),
    )
    return df.select(*[c.cast("string").alias(n) for c, n in zip(cells, OUTPUT_COLUMNS, strict=True)])


def extension_candidates(kmers: DataFrame, seed: DataFrame, most: str = "precursor_mz") -> DataFrame:
    """seed (prot_id, ion_type, start, end, precursor_mz) to longer k-mers of charge 2 from the same anchor, lighter than
    the precursor: b ones share the start, y ones the end."""
    k = kmers.where("charge = 2").select("prot_id", "ion_type", F.col("kmer").alias("longer"), F.col("start").alias("s"), F.col("end").alias("e"), "mass")
    anchor_k = F.when(F.col("ion_type") == "b", F.col("s")).otherwise(F.col("e"))
    anchor_s = F.when(F.col("ion_type") == "b", F.col("start")).otherwise(F.col("end"))
    joined = seed.withColumn("anchor", anchor_s).join(k.withColumn("anchor", anchor_k), ["prot_id", "ion_type", "anchor"])
    farther = F.when(F.col("ion_type") == "b", F.col("e") >= F.col("end")).otherwise(F.col("s") <= F.col("start"))
    return joined.where(farther & (F.col("mass") < F.col(most)))
