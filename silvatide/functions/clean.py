"""Validators, parsers and classifiers as pure Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accession prefixes, lineage prefixes, adapters, technologies, bucket bounds and size estimates.
RUN_PREFIXES = ("SRR", "ERR", "DRR")
GTDB_RANKS = {"phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}
ADAPTERS = ("AGATCGGAAGAGC", "CTGTCTCTTATACACATCT", "AATGATACGGCGACCACCGAGATCTACAC")
LENGTH_BOUNDS = (50, 100, 150, 250, 500, 1000)
PREFIX_SIZE_MB = {"ERR": 500.0, "SRR": 800.0}
OTHER_SIZE_MB = 1024.0

#: What a plain float literal looks like: the engine's own cast also takes type suffixes such as 0.5d.
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


def valid_run(acc: Column) -> Column:
    """A run accession: a known prefix and digits. Null is false."""
    return F.coalesce(acc.rlike(rf"^({'|'.join(RUN_PREFIXES)})[0-9]+\z"), F.lit(False))


def valid_genome(acc: Column) -> Column:
    """An assembly accession with nine digits and a version."""
    return F.coalesce(acc.rlike(r"^GC[AF]_\d{9}\.\d+\z"), F.lit(False))


def number(text: Column) -> Column:
    """The double that a text spells, or null."""
    return F.when(text.cast("string").rlike(_NUMBER), F.regexp_replace(F.trim(text.cast("string")), "_", "").try_cast("double"))


def containment_value(text: Column) -> Column:
    """The number if it lies in [0, 1], else null; NaN is null."""
    v = number(text)
    return F.when(v.between(0.0, 1.0), v)


def not_nan(c: Column) -> Column:
    """NaN sorts above everything here; on ingest it becomes null."""
    return F.when(~F.isnan(c), c)


def country(location: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(location, ":", 1)


def clean_species(name: Column) -> Column:
    """Drop qualifiers, strain designations and bracketed parts; squeeze white space."""
    c = F.regexp_replace(name, r"(?i)^(candidate|unclassified|uncultured)\s+", "")
    c = F.regexp_replace(c, r"(?i)\s+(sp\.|strain|isolate|clone)(\s+.*|$)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[.*?\]", ""), r"\(.*?\)", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def gtdb_rank(lineage: Column, rank: str) -> Column:
    """One rank of a `d__..;p__..;...` string; null where missing or empty."""
    found = F.trim(F.regexp_extract(lineage, rf"(?:^|;)\s*{GTDB_RANKS[rank]}__([^;]*)", 1))
    return F.when(found != "", found)


def lineage_map(lineage: Column) -> Column:
    """`rank:name;...` as a map with lower-case ranks; the last of repeated ranks counts. Null stays null."""
    parts = F.filter(F.split(lineage, ";"), lambda x: x.contains(":"))
    pairs = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    n = F.size(pairs)
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda q: q["k"] == p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~later(p, i)))


def lineage_text(taxa: Column) -> Column:
    """An array of (rank, name) as `rank:name;...`."""
    return F.array_join(F.transform(taxa, lambda t: F.concat_ws(":", t["rank"], t["name"])), ";")


def coordinates(text: Column) -> Column:
    """(lat, lon) from `[lat, lon]`, `lat, lon` or `lat lon`, with optional N/S/E/W after a number; else null."""
    s = F.trim(F.regexp_replace(text, r"[\[\]\"]", ""))
    parts = F.when(s.contains(","), F.split(s, r"\s*,\s*")).otherwise(F.split(s, r"\s+"))

    def one(p: Column, minus: str, either: str) -> Column:
        letter = F.upper(F.regexp_extract(p, r"([A-Za-z])\s*$", 1))
        v = number(F.regexp_extract(p, r"^\s*([+-]?[0-9.]+)\s*[A-Za-z]?\s*$", 1))
        return F.when((letter == "") | letter.isin(*either), F.when(letter == minus, -v).otherwise(v))

    lat, lon = one(F.get(parts, F.lit(0)), "S", "NS"), one(F.get(parts, F.lit(1)), "W", "EW")
    return F.when((F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


# The platform's name, and words of the instrument and of the strategy, that tell each technology, in order.
TECHNOLOGIES = (
    ("illumina", "illumina", ("illumina",), ()),
    ("nanopore", "oxford_nanopore", ("nanopore", "minion", "gridion"), ("nanopore",)),
    ("pacbio", "pacbio_smrt", ("pacbio", "sequel", "rs ii"), ("pacbio",)),
)


def technology(platform: Column, instrument: Column, strategy: Column) -> Column:
    """illumina, nanopore, pacbio or unknown: by platform or instrument, and only where neither tells by strategy. Nulls tell nothing."""
    p, i, s = (F.lower(F.coalesce(c, F.lit(""))) for c in (platform, instrument, strategy))
    out = F.when(F.lit(False), F.lit(""))
    for name, exact, words, _ in TECHNOLOGIES:
        out = out.when((p == exact) | F.greatest(*[i.contains(w) for w in words], F.lit(False)), name)
    for name, _, _, words in TECHNOLOGIES:
        if words:
            out = out.when(F.greatest(*[s.contains(w) for w in words], F.lit(False)), name)
    return out.otherwise("unknown")


def technology_confidence(platform: Column, instrument: Column) -> Column:
    """0.5, 0.3 more for a platform and 0.2 for an instrument, at most 1."""
    has = lambda c, x: F.when(c.isNotNull() & (c != ""), F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(0.5) + has(platform, 0.3) + has(instrument, 0.2))


def gc_fraction(seq: Column) -> Column:
    """Share of capital G and C; 0 for an empty sequence."""
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) / n).otherwise(F.lit(0.0))


def length_bucket(n: Column, bounds: Sequence[int] = LENGTH_BOUNDS) -> Column:
    """`1-50`, `51-100`, ... and `>1000`."""
    out, low = None, 1
    for b in bounds:
        label = F.lit(f"{low}-{b}")
        out = F.when(n <= b, label) if out is None else out.when(n <= b, label)
        low = b + 1
    return out.otherwise(F.lit(f">{bounds[-1]}"))


def quality_bucket(q: Column) -> Column:
    return F.when(q >= 30, "high").when(q >= 20, "medium").when(q >= 10, "low").otherwise("very_low")


def kmer_diversity(seq: Column, k: int = 3) -> Column:
    """Distinct over all k-mers; 0 for a sequence shorter than k."""
    letters = F.split(seq, "")
    kmers = letters
    for j in range(1, k):  # null where a k-mer would go beyond the end
        kmers = F.zip_with(kmers, F.slice(letters, F.lit(j + 1), F.greatest(F.length(seq), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(seq) >= k, F.size(F.array_compact(F.array_distinct(kmers))) / (F.length(seq) - (k - 1))).otherwise(F.lit(0.0))


def homopolymer_rate(seq: Column, least: int = 4) -> Column:
    """Runs of `least` or more that end before the last base, over the length; a run at the end is not counted."""
    return F.when(F.length(seq) > 0, F.regexp_count(seq, F.lit(rf"(?s)(.)\1{{{least - 1},}}+(?=.)")) / F.length(seq)).otherwise(F.lit(0.0))


def has_adapter(seq: Column, adapters: Sequence[str] = ADAPTERS) -> Column:
    return F.greatest(*[seq.contains(a) for a in adapters], F.lit(False))


def quality_points(mean_quality: Column, adapter: Column, complexity: Column) -> Column:
    """The grade's score in hundredths."""
    q = F.when(mean_quality >= 30, 40).when(mean_quality >= 20, 20).otherwise(0)
    a = F.when(adapter < 0.01, 30).when(adapter < 0.05, 10).otherwise(0)
    c = F.when(complexity > 0.7, 30).when(complexity > 0.4, 15).otherwise(0)
    return q + a + c


def quality_grade(mean_quality: Column, adapter: Column, complexity: Column) -> Column:
    s = quality_points(mean_quality, adapter, complexity)
    return F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("poor")


# The texts of recommendations, and name, weight in tenths and actions of each anomaly, in order.
QUALITY_TEXTS = ("Apply quality trimming with Q20 threshold", "Remove adapter sequences", "Check for PCR duplicates and low-complexity regions", "Dataset appears to be high quality")
ANOMALIES = (("low_complexity", 3), ("high_contamination", 4), ("unusual_gc", 2), ("high_n_content", 3), ("poor_quality", 5))
ANOMALY_ACTIONS = (
    ("high_contamination", ("Perform adapter trimming", "Check for vector contamination")),
    ("poor_quality", ("Apply quality filtering", "Consider excluding from analysis")),
    ("low_complexity", ("Check for PCR artifacts", "Verify sample preparation")),
)
FAILED_ANALYSIS = ("analysis_failed", 0.1)


def quality_recommendations(mean_quality: Column, adapter: Column, complexity: Column) -> Column:
    tests = (mean_quality < 20, adapter > 0.05, complexity < 0.3)
    found = F.array_compact(F.array(*[F.when(t, F.lit(x)) for t, x in zip(tests, QUALITY_TEXTS, strict=False)]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(QUALITY_TEXTS[-1])))


def anomaly_flags(complexity: Column, adapter: Column, gc: Column, n_content: Column, grade: Column) -> Column:
    """The names of what is anomalous, in fixed order."""
    tests = (complexity < 0.1, adapter > 0.1, (gc < 0.2) | (gc > 0.8), n_content > 0.05, grade == "poor")
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, (n, _) in zip(tests, ANOMALIES, strict=True)]))


def anomaly_reasons(flags: Column, adapter: Column, gc: Column, n_content: Column) -> Column:
    """One sentence for each flag, joined."""
    percent = lambda text, x: F.format_string(text + ": %.1f%%", x * 100.0)
    texts = (
        F.lit("Very low sequence complexity"), percent("High adapter contamination", adapter), percent("Unusual GC content", gc),
        percent("High N content", n_content), F.lit("Poor overall quality"),
    )
    return F.concat_ws("; ", *[F.when(F.array_contains(flags, n), x) for (n, _), x in zip(ANOMALIES, texts, strict=True)])


def anomaly_severity(flags: Column) -> Column:
    """Sum of weights, at most 1; summed in tenths so that it is exact."""
    tenths = sum((F.when(F.array_contains(flags, n), w).otherwise(0) for n, w in ANOMALIES), F.lit(0))
    return F.least(tenths, F.lit(10)) / 10.0


def anomaly_actions(flags: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.array_contains(flags, n), F.array(*[F.lit(a) for a in acts])).otherwise(none) for n, acts in ANOMALY_ACTIONS])


def processing_parameters(mean_length: Column, grade: Column, adapter: Column, over_represented: Column, complexity: Column, total_reads: Column, total_bases: Column) -> Column:
    """A struct of suggested settings for a dataset: pipeline by read length, trimming by grade, filters by what contaminates it,
    memory, cores and storage by size, and hours, of which trimming takes half as many again and filtering 0.3."""
    trim = grade.isin("poor", "fair")
    filters = (adapter > 0.05) | (over_represented > 0.05)
    hours = total_reads / 5e6 * F.when(trim, 1.5).otherwise(1.0) * F.when(filters, 1.3).otherwise(1.0)
    return F.struct(
        F.when(mean_length > 1000, "long_read").when(mean_length > 250, "paired_end").otherwise("short_read").alias("pipeline"),
        F.struct(trim.alias("enabled"), F.when(grade == "poor", 20).otherwise(15).alias("quality_threshold"), F.greatest(F.lit(50), F.floor(mean_length * 0.7)).cast("int").alias("min_length")).alias("quality_trimming"),
        F.struct((adapter > 0.01).alias("enabled"), F.when(adapter > 0.1, "high").otherwise("medium").alias("stringency")).alias("adapter_removal"),
        F.struct(filters.alias("enabled"), F.lit(True).alias("check_vector"), (adapter > 0.01).alias("check_adapters"), (complexity < 0.3).alias("complexity_filter")).alias("contamination_filtering"),
        F.struct(
            F.when(mean_length < 150, "auto").otherwise("31").alias("kmer_size"), F.when(grade.isin("good", "excellent"), 5).otherwise(10).alias("coverage_cutoff"), (grade != "excellent").alias("error_correction")
        ).alias("assembly_parameters"),
        F.struct(
            F.greatest(F.lit(8), F.floor(total_reads / 1e7) * 2).cast("long").alias("memory_gb"),
            F.when(total_reads < 50_000_000, 4).otherwise(8).alias("cpu_cores"),
            F.greatest(F.lit(10), F.floor(total_bases / 1e9) * 5).cast("long").alias("storage_gb"),
        ).alias("computational_requirements"),
        F.format_string("%.1f hours", hours).alias("estimated_time"),
    )


def estimated_size_mb(acc: Column, known_mb: Column | None = None) -> Column:
    """The known size, else an estimate by prefix."""
    guess = F.lit(OTHER_SIZE_MB)
    for prefix, mb in reversed(list(PREFIX_SIZE_MB.items())):
        guess = F.when(acc.startswith(prefix), F.lit(mb)).otherwise(guess)
    return guess if known_mb is None else F.coalesce(known_mb, guess)


def size_bucket(mb: Column) -> Column:
    """Order of downloads: 0 small, 1 medium, 2 unknown, 3 large."""
    return F.when(mb.isNull() | (mb <= 0), 2).when(mb < 100, 0).when(mb < 1000, 1).otherwise(3)


def transfer_hours(size_gb: Column, mbps: float = 100.0, parallel: int = 4) -> Column:
    """Hours at four fifths of the bandwidth of all connections."""
    return size_gb * 1024 * 8 / (mbps * parallel * 0.8) / 3600


def planned_transfer_minutes(size_mb: Column, n: Column, mbps: float = 10.0, optimal: int = 4) -> Column:
    """Size over four fifths of the bandwidth. More than one of k = min(n, optimal) connections multiply it by k, less a tenth of that for each after the first."""
    k = F.least(n, F.lit(optimal))
    return size_mb / (mbps * 0.8 * F.when(k > 1, k * (1 - 0.1 * (k - 1))).otherwise(1.0))


def histogram_bins(n: Column) -> Column:
    return F.when(n <= 2, 5).when(n <= 10, F.least(F.lit(20), F.greatest(F.lit(5), F.floor(n / 2) + 1))).otherwise(20).cast("int")


def displayed_containment(v: Column) -> Column:
    """Clamped to [0, 1] with three decimals; null is 0."""
    return F.format_string("%.3f", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(0.0)))))


def validation_confidence(original: Column, matched: Column, failed: Column) -> Column:
    """high for the same name whatever its case, medium for another match, low for none, error for a failed look-up."""
    return F.when(failed, "error").when(matched.isNull(), "low").when(F.lower(original) == F.lower(matched), "high").otherwise("medium")


def mate_name(name: Column) -> Column:
    """The name of the second file of a pair, or null for any other file."""
    return F.when(name.contains("_R1"), F.replace(name, F.lit("_R1"), F.lit("_R2"))).when(name.contains("_1"), F.replace(name, F.lit("_1"), F.lit("_2")))
