"""Queries over bases, k-mers, seeds, hits and SAM lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bases
from ..functions.scores import adler32, dcode, parse_dcode
from ..operators import alignments, intervals, loci, seeding
from ..operators import seed_index as seed_index_of
from ..operators.tiles import longest_of
from ..session import scratch_path
from ..sources.bam import read_bam, write_bam
from ..sources.fasta import index_fasta
from ..sources.fixtures import GENOME_SQL, READS_SQL, genome, reads
from ..sources.formats import parse_sam_lines, read_bed, read_fasta, read_reads, read_sam, sam_hits

K, STEP = seeding.SEED, seeding.STEP
DULL = "A" * K


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = genome(spark, sf_dir)
    counts = [F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("long").alias(b) for b in "ACGT"]
    return g.agg(*counts).unpivot([], list("ACGT"), "base", "n")


def encoded_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    codes = bases.encode("text")
    return rows.select("item_id", codes.alias("codes"), bases.encode("text", uracil=True).alias("rna_codes"), bases.decode(codes).alias("letters"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome(spark, sf_dir).select("chrom_idx", bases.reverse_complement("seq").alias("rc"))


def kmer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.genome_kmers(genome(spark, sf_dir)).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each k-mer's entries begin in a sorted index: sums inside a prefix, and over the prefixes before."""
    counts = kmer_histogram(spark, sf_dir).withColumn("prefix", F.substring("kmer", 1, 3))
    sizes = counts.groupBy("prefix").agg(F.sum("n").alias("size"))
    before = sizes.select(F.col("prefix").alias("p"), (F.sum("size").over(Window.orderBy("prefix")) - F.col("size")).alias("before"))  # 64 rows
    inner = F.sum("n").over(Window.partitionBy("prefix").orderBy("kmer")) - F.col("n")
    return counts.withColumn("inner", inner).join(before, F.col("prefix") == F.col("p")).select("kmer", "n", (F.col("before") + F.col("inner")).alias("offset"))


def seed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.read_seeds(reads(spark, sf_dir))


def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.seed_hits(genome(spark, sf_dir), reads(spark, sf_dir))


def indexed_seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed hits, read off a stored index."""
    r = reads(spark, sf_dir)
    return seed_index_of.indexed_hits(seed_index_of.build_index(genome(spark, sf_dir), longest_read(spark, sf_dir)), r)


def seed_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.diagonals(seed_hits(spark, sf_dir))


def seed_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.suppressed(seed_hits(spark, sf_dir), reads(spark, sf_dir))


def verify_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, r = genome(spark, sf_dir), reads(spark, sf_dir)
    return seeding.windows(g, r, seeding.diagonals(seeding.seed_hits(g, r)))


def verify_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reads against all windows that seeds of the whole reads name."""
    g, r = genome(spark, sf_dir), reads(spark, sf_dir)
    windowed = seeding.windows(g, r, seeding.diagonals(seeding.seed_hits(g, r, whole=True)))
    return seeding.verified(windowed, whole=True).select("read_id", "strand", "chrom_idx", "diagonal", "error", "start")


def top10_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeding.search(genome(spark, sf_dir), reads(spark, sf_dir))


def exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by seeds alone, as SQL can follow them: a read's places ranked by seeds, then in scan order."""
    d = seeding.diagonals(seed_hits(spark, sf_dir)).where("diagonal >= 0")
    order = Window.partitionBy("read_id").orderBy(F.desc("seeds"), "chrom_idx", "diagonal", "strand")
    ranked = d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= seeding.TOP)
    lengths = reads(spark, sf_dir).select("read_id", F.length("seq").alias("len"))
    return loci.hits_of(ranked.join(lengths, "read_id").withColumn("start", F.col("diagonal").cast("long")))


def longest_read(spark: SparkSession, sf_dir: str) -> int:
    return longest_of(reads(spark, sf_dir), F.length("seq"))


def locus_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.locus_sequences(genome(spark, sf_dir), exact_hits(spark, sf_dir), longest=longest_read(spark, sf_dir)).select("read_id", "hit_idx", "locus_start", "locus_stop", "locus")


def locus_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = loci.locus_depths(exact_hits(spark, sf_dir))
    return d.select(*loci.LOCUS, F.round("depth", 6).alias("depth"), F.round("weight", 6).alias("weight"))


def seed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed hits dressed as places of a search, the error being a number of the place."""
    h = exact_hits(spark, sf_dir)
    return h.select("read_id", "chrom_idx", "start", "strand", (F.col("stop") - F.col("start")).alias("len"), (F.col("hit_idx") + 1).alias("rank"), (F.col("start") % 7).cast("int").alias("error"))


def sam_render_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.seed_records(seed_places(spark, sf_dir), reads(spark, sf_dir), genome(spark, sf_dir))


def sam_parse_xa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered lines read back: every place of every mapped read."""
    lines = sam_render_seed(spark, sf_dir).select(F.col("line").alias("value"))
    return sam_hits(parse_sam_lines(lines)).select("name", "hit_idx", "num_hits", "chrom", "start", "stop", "strand")


def sam_unaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return alignments.unaligned_records(r.join(exact_hits(spark, sf_dir).select("read_id").distinct(), "read_id", "left_anti"))


def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments.header(genome(spark, sf_dir), "1.0", "unsorted", "seqlattice")


def place_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = exact_hits(spark, sf_dir).join(reads(spark, sf_dir).select("read_id", "name"), "read_id")
    text = F.concat(F.col("hit_idx").cast("string"), "name", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("\n"))
    return h.select("read_id", "hit_idx", adler32(text).alias("adler"))


def dcode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL")
    parts = [F.pmod(F.col("doc_id") * m + a, F.lit(256)) for m, a in ((1, 1), (3, 5), (7, 2), (11, 9), (13, 0))]
    named = rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "run.sam").otherwise(F.concat(F.lit("run.DCODE"), dcode(*parts), F.lit(".sam"))).alias("file"))
    keys = ("threads", "siter", "giter", "spseudo", "gpseudo")
    return named.select("doc_id", "file", *[c.alias(k) for c, k in zip(parse_dcode(F.col("file")), keys, strict=True)])


def longest_read_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).agg(F.max(F.length("seq")).alias("longest"))


def reversed_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities made from the bases, and of one read in three none, as they stand on the other strand."""
    qual = F.when(F.col("read_id") % 3 == 0, F.lit("*")).otherwise(F.translate("seq", "ACGT", "!5?I"))
    return reads(spark, sf_dir).select("read_id", bases.reverse_qualities(qual).alias("qual"))


def paths_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment paths made from hits as SQL can follow them: the read laid against its locus base by base.

    Flanks face outer gaps; by hit, one base is now inserted, now deleted, at a place that follows from the ids.
    """
    h = locus_rows(spark, sf_dir).join(reads(spark, sf_dir).select("read_id", F.col("seq").alias("own")), "read_id")
    h = h.withColumn("locus", F.explode(F.array("locus")))  # worked out once, not for each base
    n, m = F.length("own"), F.length("locus")
    lead = F.when(F.col("strand") == "-", F.col("locus_stop") - F.col("stop")).otherwise(F.col("start") - F.col("locus_start")).cast("int")
    kind, at = (F.col("read_id") + F.col("hit_idx")) % 3, ((F.col("read_id") * 7 + F.col("hit_idx")) % 9 + 3).cast("int")
    shift = lambda i: F.when((kind == 1) & (i > at), 1).when((kind == 2) & (i >= at), -1).otherwise(0)
    letter = lambda s, i: F.instr(F.lit("ACGT"), F.substring(s, i, F.lit(1))) - 1

    def columns(i):
        g = lead + i + shift(i)
        base = F.when((kind == 2) & (i == at), 5).when((g < 1) | (g > m), 5).otherwise(letter("locus", g))
        one = letter("own", i) * 16 + base
        skipped = F.array(one, 80 + letter("locus", g + 1))
        return F.when((kind == 1) & (i == at) & (g >= 0) & (g < m), skipped).otherwise(F.array(one))

    flank = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda i: 80 + letter("locus", i))).otherwise(F.array().cast("array<int>"))
    end = lead + n + shift(n)
    path = F.concat(flank(F.lit(1), lead), F.flatten(F.transform(F.sequence(F.lit(1), n), columns)), flank(end + 1, m))
    return h.select("read_id", "hit_idx", "strand", path.alias("path"))


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of hits against regions: every third chromosome as a whole, of the others 100 of every 150 bases."""
    g = genome(spark, sf_dir)
    whole = g.where("chrom_idx % 3 = 0").select("chrom_idx", F.lit(0).alias("start"), F.col("seq_len").alias("stop"))
    parts = g.where("chrom_idx % 3 > 0").select("chrom_idx", F.explode(F.sequence(F.lit(0), F.col("seq_len") - 1, F.lit(150))).alias("start"))
    regions = whole.unionByName(parts.withColumn("stop", F.col("start") + 100))
    met = intervals.overlaps(exact_hits(spark, sf_dir), regions, "chrom_idx", 5)
    return met.select("read_id", "hit_idx", "chrom_idx", "other_start", "other_stop", "shared")


def locus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loci.locus_sequences(genome(spark, sf_dir), exact_hits(spark, sf_dir), longest=longest_read(spark, sf_dir))


def cigar_md_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths rendered as they lie on the genome's plus strand."""
    path = F.when(F.col("strand") == "-", alignments.reverse_path(F.col("path"))).otherwise(F.col("path"))
    return paths_of_hits(spark, sf_dir).select("read_id", "hit_idx", alignments.rendered(path).alias("r")).select("read_id", "hit_idx", "r.*")


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome written as FASTA, in lines of 60 bases, and read again."""
    g = genome(spark, sf_dir)
    body = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), "\n")
    path = scratch_path(spark)
    g.select(F.concat(F.lit(">"), "chrom", F.lit(" of "), F.col("seq_len").cast("string"), F.lit("\n"), body).alias("record")).write.text(path)
    return read_fasta(spark, path)


def _indexed(spark: SparkSession, sf_dir: str):
    """The genome as FASTA files with lines of 60 bases and odd headers, and their index in stretches of a few lines."""
    body = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), "\n")
    path = scratch_path(spark)
    genome(spark, sf_dir).select(F.concat(F.lit(">"), "chrom", F.lit(" a->b >x\n"), body).alias("record")).write.text(path)
    return index_fasta(spark, path, stretch=1_000, split=50_000)


def fasta_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 100 bases and the next 20, cut from byte ranges."""
    g = _indexed(spark, sf_dir)
    return g.tiles(100, 20).join(g.chromosomes.select("chrom_idx", "chrom"), "chrom_idx").select("chrom", "tile", "part", "seq_len")


def fasta_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of hits, read by their own bytes."""
    g = _indexed(spark, sf_dir)
    hits = exact_hits(spark, sf_dir).select("read_id", "hit_idx", F.concat(F.lit("doc"), F.col("chrom_idx").cast("string")).alias("chrom"), (F.col("start") - 5).alias("start"), (F.col("stop") + 5).alias("stop"))
    return g.fetch(hits.join(g.chromosomes, "chrom"), ["read_id", "hit_idx"])


def reads_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and as FASTA and read again."""
    r = reads(spark, sf_dir).withColumn("qual", F.translate("seq", "ACGT", "!@>I"))
    out = []
    for kind, record in (("fastq", F.concat(F.lit("@"), "name", F.lit(" x\n"), "seq", F.lit("\n+\n"), "qual")), ("fasta", F.concat(F.lit(">"), "name", F.lit("\n"), "seq"))):
        path = scratch_path(spark)
        r.select(record.alias("record")).write.text(path)
        out.append(read_reads(spark, path).select(F.lit(kind).alias("kind"), "name", "seq", "qual"))
    return out[0].unionByName(out[1])


def bed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes as BED lines of three to six columns among comments, parsed."""
    g, i = genome(spark, sf_dir), F.col("chrom_idx")
    three = F.concat_ws("\t", "chrom", (i % 7).cast("string"), (i % 7 + F.col("seq_len")).cast("string"))
    line = F.when(i % 5 == 0, F.concat(F.lit("#"), three)).when(i % 5 == 1, three).when(i % 5 == 2, F.concat(three, F.lit("\tname"))).otherwise(F.concat(three, F.lit("\tname\t0\t"), F.when(i % 2 == 0, "+").otherwise("-")))
    path = scratch_path(spark)
    g.select(line.alias("line")).write.text(path)
    return read_bed(spark, path)


def sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and seed records written as a SAM file and read again: all fields, also those of unaligned reads."""
    path = scratch_path(spark)
    lines = sam_render_seed(spark, sf_dir).select(F.col("read_id").alias("chrom_idx"), F.lit(0).cast("long").alias("pos"), "line")
    alignments.write_sam(genome(spark, sf_dir), lines, path, version="1.3", order="coordinate")
    head = spark.read.text(path).where(F.col("value").startswith("@")).select(F.lit("@").alias("name"), F.col("value").alias("fields"))
    e = read_sam(spark, path)
    fields = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "nm", "xa")])
    return head.unionByName(e.select("name", fields.alias("fields")))


def bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed records parsed, written as BAM files with small members, and read again in splits of a few members."""
    entries = parse_sam_lines(sam_render_seed(spark, sf_dir).select(F.col("line").alias("value")))
    path = scratch_path(spark)
    write_bam(entries.repartition(3), genome(spark, sf_dir), path, block=3_000)
    fields = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("flag", "chrom", "pos", "mapq", "cigar", "seq", "qual", "nm", "xa")])
    return read_bam(spark, path, 10_000).select("name", fields.alias("fields"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by the documents' ids, with and without folder, id and code, listed by suffix."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select("doc_id")
    i = F.col("doc_id")
    code = F.when(i % 2 == 0, dcode(*[(i + k) % 256 for k in range(5)]))
    run = F.when(i % 3 == 0, F.concat(F.lit("run"), i.cast("string")))
    return rows.select("doc_id", alignments.output_names(F.lit("aln"), F.lit("sam"), F.when(i % 5 == 0, F.lit("out/")), run, code).alias("file"))


KMERS_SQL = f"""kmers AS (SELECT chrom_idx, i - 1 AS pos, substr(seq, i, {K}) AS kmer FROM (SELECT chrom_idx, seq, unnest(range(1, seq_len - {K} + 2)) AS i FROM genome))"""
SEEDS_SQL = f"""strands AS (SELECT read_id, '+' AS strand, substr(seq, 1, 64) AS s, 0 AS o FROM reads
  UNION ALL SELECT read_id, '-', substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, 64), (least(length(seq), 64) - {K}) % {STEP} FROM reads),
seeds AS (SELECT read_id, strand, CAST("offset" AS INTEGER) AS "offset", substr(s, "offset" + 1, {K}) AS kmer
  FROM (SELECT read_id, strand, s, unnest(range(o, length(s) - {K} + 1, {STEP})) AS "offset" FROM strands))"""
HITS_SQL = f"""{GENOME_SQL}, {READS_SQL}, {KMERS_SQL}, {SEEDS_SQL},
hits AS MATERIALIZED (SELECT read_id, strand, "offset", chrom_idx, CAST(pos AS INTEGER) AS pos FROM kmers JOIN seeds USING (kmer) WHERE kmer <> '{DULL}')"""
DIAGONALS_SQL = f"""{HITS_SQL}, diagonals AS (SELECT read_id, strand, chrom_idx, pos - "offset" AS diagonal, count(*) AS seeds FROM hits GROUP BY ALL)"""
EXACT_SQL = f"""{DIAGONALS_SQL},
exact AS MATERIALIZED (SELECT read_id, CAST(rank - 1 AS INTEGER) AS hit_idx, chrom_idx, CAST(diagonal AS BIGINT) AS start, CAST(diagonal + length(seq) AS BIGINT) AS stop, strand, seq, name,
                 count(*) OVER (PARTITION BY read_id) AS num_hits
  FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY seeds DESC, chrom_idx, diagonal, strand) AS rank FROM diagonals WHERE diagonal >= 0) JOIN reads USING (read_id) WHERE rank <= 10)"""
WEIGHTS_SQL = f"""{EXACT_SQL},
depths AS (SELECT chrom_idx, start, stop, strand, sum(1.0::DOUBLE / num_hits) AS depth FROM exact GROUP BY ALL),
weights AS MATERIALIZED (SELECT *, CASE WHEN depth < 10 THEN 1.0 WHEN depth < 10000 THEN 1 / log10(depth) ELSE 0.25 END AS weight FROM depths)"""
LOCI_SQL = f"""{WEIGHTS_SQL},
cut AS MATERIALIZED (SELECT e.*, genome.seq AS chrom_seq, greatest(start - 5, 0) AS locus_start, least(stop + 5, seq_len) AS locus_stop FROM exact e JOIN genome USING (chrom_idx)),
loci AS MATERIALIZED (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(plus, 'ACGT', 'TGCA')) ELSE plus END AS locus
  FROM (SELECT *, substr(chrom_seq, locus_start + 1, locus_stop - locus_start) AS plus FROM cut))"""
PLACES_SQL = f"""{EXACT_SQL},
placed AS (SELECT e.*, genome.chrom, stop - start AS len, start % 7 AS error FROM exact e JOIN genome USING (chrom_idx))"""
SAM_SQL = f"""{PLACES_SQL},
lists AS (SELECT read_id, list(placed ORDER BY hit_idx) AS p FROM placed GROUP BY read_id),
lines AS (SELECT read_id, CASE WHEN p IS NULL THEN concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, qual)
  ELSE concat_ws(chr(9), name, CASE WHEN p[1].strand = '-' THEN '16' ELSE '0' END, p[1].chrom, CAST(p[1].start + 1 AS VARCHAR), '255', p[1].len || 'M', '*', '0', '0',
    CASE WHEN p[1].strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, qual, 'NM:i:' || p[1].error)
    || CASE WHEN len(p) > 1 THEN chr(9) || 'XA:Z:' || array_to_string(list_transform(p[2:], lambda x: x.chrom || ',' || x.strand || (x.start + 1) || ',' || x.len || 'M,' || x.error || ';'), '') ELSE '' END END AS line
  FROM reads LEFT JOIN lists USING (read_id))"""

QUERIES = {
    f.__name__: f
    for f in (
        base_composition, encoded_bases, reverse_complement, kmer_histogram, kmer_prefix_sum, seed_index, seed_hits, indexed_seed_hits, seed_diagonals, seed_suppression, verify_windows,
        verify_edit_distance, top10_hits, exact_hits, locus_sequence, locus_weight, sam_render_seed, sam_parse_xa, sam_unaligned, sam_header, place_digest, dcode_roundtrip,
        longest_read_length, reversed_qualities, cigar_md_nm, fasta_roundtrip, fasta_tiles, fasta_fetch, interval_overlaps, reads_roundtrip, bed_roundtrip, sam_roundtrip, bam_roundtrip, output_names,
    )
}

# CIGAR, MD and NM of paths, from rows (read_id, hit_idx, p, r, b) of a table plus
RENDER_SQL = """own AS (SELECT *, min(p) FILTER (r <> '-') OVER w AS p0, max(p) FILTER (r <> '-') OVER w AS p1 FROM plus WINDOW w AS (PARTITION BY read_id, hit_idx)),
kept AS (SELECT read_id, hit_idx, p, p0, r, b, CASE WHEN r = '-' THEN 'D' WHEN b = '-' THEN 'I' ELSE 'M' END AS k, CASE WHEN r <> '-' AND b <> '-' AND r <> b THEN 1 ELSE 0 END AS x FROM own WHERE p BETWEEN p0 AND p1),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY read_id, hit_idx, k ORDER BY p) AS run FROM kept),
cigars AS (SELECT read_id, hit_idx, string_agg(c, '' ORDER BY p) AS cigar FROM (SELECT read_id, hit_idx, min(p) AS p, count(*) || k AS c FROM runs GROUP BY read_id, hit_idx, k, run) GROUP BY read_id, hit_idx),
marks AS (SELECT *, sum(CASE WHEN x = 1 OR k = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id, hit_idx ORDER BY p) AS part, lag(k) OVER (PARTITION BY read_id, hit_idx ORDER BY p) AS before FROM kept),
parts AS (SELECT read_id, hit_idx, part, count(*) FILTER (k = 'M' AND x = 0) AS same, max(CASE WHEN x = 1 THEN b WHEN k = 'D' AND before = 'D' THEN b WHEN k = 'D' THEN '^' || b END) AS mark, bool_or(k = 'D' AND before = 'D') AS joined,
  max(part) OVER (PARTITION BY read_id, hit_idx) AS last FROM marks GROUP BY read_id, hit_idx, part),
flow AS (SELECT *, coalesce(lead(joined) OVER (PARTITION BY read_id, hit_idx ORDER BY part), false) AS hush FROM parts),
mds AS (SELECT read_id, hit_idx, CASE WHEN min(part) > 0 THEN '0' ELSE '' END || string_agg(coalesce(mark, '') || CASE WHEN part = last THEN CASE WHEN same > 0 OR mark IS NOT NULL OR part = 0 THEN CAST(same AS VARCHAR) ELSE '' END WHEN hush THEN '' ELSE CAST(same AS VARCHAR) END, '' ORDER BY part) AS md FROM flow GROUP BY read_id, hit_idx),
nms AS (SELECT read_id, hit_idx, CAST(min(p0) - 1 AS INTEGER) AS add, CAST(sum(CASE WHEN k <> 'M' THEN 1 ELSE x END) AS INTEGER) AS nm FROM kept GROUP BY read_id, hit_idx)"""

# a path's columns as rows: i counts read bases; d = 1 for a genome base that the read skips; f marks flanks
PATHS_SQL = f"""{LOCI_SQL},
ways AS (SELECT *, length(seq) AS n, length(locus) AS m, CASE WHEN strand = '-' THEN locus_stop - stop ELSE start - locus_start END AS lo, (read_id + hit_idx) % 3 AS kind, (read_id * 7 + hit_idx) % 9 + 3 AS spot FROM loci),
steps AS (SELECT read_id, hit_idx, strand, seq, locus, n, m, lo, kind, spot, i, lo + i + CASE WHEN kind = 1 AND i > spot THEN 1 WHEN kind = 2 AND i >= spot THEN -1 ELSE 0 END AS g FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM ways)),
cols AS (SELECT read_id, hit_idx, strand, n, i AS o, 0 AS d, 0 AS f, substr(seq, CAST(i AS BIGINT), 1) AS r, CASE WHEN kind = 2 AND i = spot OR g < 1 OR g > m THEN '-' ELSE substr(locus, CAST(g AS BIGINT), 1) END AS b FROM steps
  UNION ALL SELECT read_id, hit_idx, strand, n, i, 1, 0, '-', substr(locus, CAST(g + 1 AS BIGINT), 1) FROM steps WHERE kind = 1 AND i = spot AND g >= 0 AND g < m
  UNION ALL SELECT read_id, hit_idx, strand, n, i - lo, 0, 1, '-', substr(locus, CAST(i AS BIGINT), 1) FROM (SELECT *, unnest(range(1, lo + 1)) AS i FROM ways)
  UNION ALL SELECT read_id, hit_idx, strand, n, n + i, 0, 1, '-', substr(locus, CAST(lo + n + shift + i AS BIGINT), 1) FROM (SELECT *, unnest(range(1, m - lo - n - shift + 1)) AS i FROM (SELECT *, CASE WHEN kind = 1 AND n > spot THEN 1 WHEN kind = 2 AND n >= spot THEN -1 ELSE 0 END AS shift FROM ways))),
plus AS (SELECT read_id, hit_idx, row_number() OVER (PARTITION BY read_id, hit_idx ORDER BY CASE WHEN strand = '-' THEN -o ELSE o END, CASE WHEN strand = '-' THEN -d ELSE d END) AS p,
  CASE WHEN strand = '-' THEN translate(r, 'ACGT', 'TGCA') ELSE r END AS r, CASE WHEN strand = '-' THEN translate(b, 'ACGT', 'TGCA') ELSE b END AS b FROM cols),
{RENDER_SQL}"""
EDITS_SQL = f"""{DIAGONALS_SQL},
w AS (SELECT d.read_id, d.strand, d.chrom_idx, d.diagonal, length(r.seq) AS len, substr(CASE WHEN d.strand = '+' THEN r.seq ELSE reverse(translate(r.seq, 'ACGT', 'TGCA')) END, 1, 64) AS read, greatest(d.diagonal, 0) AS window_start,
             least(d.diagonal + length(r.seq) + 10, g.seq_len) AS stop, g.seq FROM diagonals d JOIN reads r USING (read_id) JOIN genome g ON g.chrom_idx = d.chrom_idx),
cut AS (SELECT *, substr(seq, window_start + 1, greatest(stop - window_start, 0)) AS win FROM w),
near AS MATERIALIZED (SELECT *, least(length(read), levenshtein(read, substr(win, 1, length(read))), levenshtein(read, substr(win, 1 + greatest(diagonal, 0) - window_start, length(read)))) AS bound FROM cut),
pieces AS (SELECT DISTINCT read, win, bound, s, unnest(range(greatest(1, length(read) - bound), least(length(read) + bound, length(win) - s) + 1)) AS size FROM (SELECT DISTINCT read, win, bound, unnest(range(0, length(win))) AS s FROM near)),
scores AS (SELECT read, win, s, min(levenshtein(read, substr(win, CAST(s + 1 AS BIGINT), CAST(size AS BIGINT)))) AS e FROM pieces GROUP BY ALL),
best AS MATERIALIZED (SELECT read, win, min(e) AS e, max(s) FILTER (e = low) AS s FROM (SELECT *, min(e) OVER (PARTITION BY read, win) AS low FROM scores) GROUP BY read, win),
checked AS (SELECT read_id, strand, chrom_idx, diagonal, len, CAST(CASE WHEN e < length(near.read) THEN e ELSE length(near.read) END AS INTEGER) AS error, CAST(window_start + CASE WHEN e < length(near.read) THEN s ELSE length(near.win) END AS BIGINT) AS start
  FROM near LEFT JOIN best ON best.read = near.read AND best.win = near.win)"""
WHOLE_EDITS_SQL = EDITS_SQL.replace(", 1, 64)", ", 1)").replace("least(length(seq), 64)", "length(seq)")  # seeds and comparisons of whole reads

TOP_SQL = f"""{EDITS_SQL}, places AS (SELECT read_id, strand, chrom_idx, start, CAST(min(error) AS INTEGER) AS error, CAST(any_value(len) AS INTEGER) AS len FROM checked WHERE error < 15 GROUP BY read_id, strand, chrom_idx, start),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY read_id ORDER BY error, chrom_idx, start, strand) AS INTEGER) AS rank FROM places)"""

ORACLE_SQL = {
    "longest_read_length": f"WITH {READS_SQL} SELECT CAST(max(length(seq)) AS INTEGER) AS longest FROM reads",
    "reversed_qualities": f"WITH {READS_SQL} SELECT read_id, CASE WHEN read_id % 3 = 0 THEN '*' ELSE reverse(translate(seq, 'ACGT', '!5?I')) END AS qual FROM reads",
    "cigar_md_nm": f"WITH {PATHS_SQL} SELECT read_id, hit_idx, add, cigar, md, nm FROM nms JOIN cigars USING (read_id, hit_idx) JOIN mds USING (read_id, hit_idx)",
    "verify_edit_distance": f"WITH {WHOLE_EDITS_SQL} SELECT read_id, strand, chrom_idx, diagonal, error, start FROM checked",
    "top10_hits": f"WITH {TOP_SQL} SELECT read_id, strand, chrom_idx, start, error, len, rank FROM r WHERE rank <= 10",
    "fasta_roundtrip": f"WITH {GENOME_SQL} SELECT chrom, seq, CAST(seq_len AS INTEGER) AS seq_len FROM genome",
    "fasta_tiles": f"WITH {GENOME_SQL} SELECT chrom, tile, substr(seq, CAST(tile * 100 + 1 AS BIGINT), 120) AS part, seq_len FROM (SELECT *, unnest(range(0, (seq_len + 99) // 100)) AS tile FROM genome)",
    "interval_overlaps": f"""WITH {EXACT_SQL}, regions AS (SELECT chrom_idx, CAST(0 AS BIGINT) AS a, CAST(seq_len AS BIGINT) AS b FROM genome WHERE chrom_idx % 3 = 0
  UNION ALL SELECT chrom_idx, i * 150, i * 150 + 100 FROM (SELECT chrom_idx, unnest(range(0, (seq_len - 1) // 150 + 1)) AS i FROM genome WHERE chrom_idx % 3 > 0))
SELECT read_id, hit_idx, e.chrom_idx, a AS other_start, b AS other_stop, least(e.stop, b) - greatest(e.start, a) AS shared FROM exact e JOIN regions r ON r.chrom_idx = e.chrom_idx AND least(e.stop, b) - greatest(e.start, a) >= 5""",
    "fasta_fetch": f"WITH {LOCI_SQL} SELECT read_id, hit_idx, plus AS seq FROM loci",
    "reads_roundtrip": f"WITH {READS_SQL} SELECT 'fastq' AS kind, name, seq, translate(seq, 'ACGT', '!@>I') AS qual FROM reads UNION ALL SELECT 'fasta', name, seq, '*' FROM reads",
    "bed_roundtrip": f"""WITH {GENOME_SQL} SELECT chrom, chrom_idx % 7 AS start, chrom_idx % 7 + seq_len AS stop, CASE WHEN chrom_idx % 5 > 2 AND chrom_idx % 2 = 1 THEN '-' ELSE '+' END AS strand FROM genome WHERE chrom_idx % 5 <> 0""",
    "sam_roundtrip": f"""WITH {SAM_SQL},
f AS (SELECT line, str_split(line, chr(9)) AS f FROM lines)
SELECT '@' AS name, '@HD' || chr(9) || 'VN:1.3' || chr(9) || 'SO:coordinate' AS fields
UNION ALL SELECT '@', '@SQ' || chr(9) || 'SN:' || chrom || chr(9) || 'LN:' || seq_len FROM genome
UNION ALL SELECT f[1], concat_ws('|', f[2], f[3], f[4], f[5], f[6], f[10], f[11], CASE WHEN len(f) >= 12 THEN replace(f[12], 'NM:i:', '') ELSE '-' END, CASE WHEN len(f) >= 13 THEN replace(f[13], 'XA:Z:', '') ELSE '-' END) FROM f""",
    "bam_roundtrip": f"""WITH {SAM_SQL}, f AS (SELECT str_split(line, chr(9)) AS f FROM lines)
SELECT f[1] AS name, concat_ws('|', f[2], f[3], f[4], f[5], f[6], f[10], f[11], CASE WHEN len(f) >= 12 THEN replace(f[12], 'NM:i:', '') ELSE '-' END, CASE WHEN len(f) >= 13 THEN replace(f[13], 'XA:Z:', '') ELSE '-' END) AS fields FROM f""",
    "output_names": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'out/' ELSE '' END || 'aln.' || CASE WHEN doc_id % 3 = 0 THEN 'run' || doc_id || '.' ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN 'DCODE' || lpad(printf('%X', ((((doc_id % 256) * 256 + (doc_id + 1) % 256) * 256 + (doc_id + 2) % 256) * 256 + (doc_id + 3) % 256) * 256 + (doc_id + 4) % 256), 16, '0') || '.' ELSE '' END || 'sam' AS file FROM documents WHERE doc_id IS NOT NULL""",
    "base_composition": f"WITH {GENOME_SQL} SELECT base, CAST(sum(length(seq) - length(replace(seq, base, ''))) AS BIGINT) AS n FROM genome, (VALUES ('A'), ('C'), ('G'), ('T')) b(base) GROUP BY base",
    "encoded_bases": """SELECT item_id, translate(d, 'ACGTNacgt', '012340123') AS codes, translate(u, 'ACGTUNacgtu', '01233401233') AS rna_codes, translate(translate(d, 'acgt', 'ACGT'), 'ACGTN', 'ACGTN') AS letters
FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '[^ACGTacgt]', 'N', 'g') AS d, regexp_replace(coalesce(text, ''), '[^ACGTUacgtu]', 'N', 'g') AS u FROM benchmark)""",
    "reverse_complement": f"WITH {GENOME_SQL} SELECT chrom_idx, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM genome",
    "kmer_histogram": f"WITH {GENOME_SQL}, {KMERS_SQL} SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer",
    "kmer_prefix_sum": f"""WITH {GENOME_SQL}, {KMERS_SQL}, c AS (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer)
SELECT kmer, n, CAST(sum(n) OVER (ORDER BY kmer) - n AS BIGINT) AS "offset" FROM c""",
    "seed_index": f"WITH {READS_SQL}, {SEEDS_SQL} SELECT * FROM seeds",
    "seed_hits": f"WITH {HITS_SQL} SELECT * FROM hits",
    "indexed_seed_hits": f"WITH {HITS_SQL} SELECT * FROM hits",
    "seed_diagonals": f"WITH {DIAGONALS_SQL} SELECT * FROM diagonals",
    "seed_suppression": f"""WITH RECURSIVE {HITS_SQL},
ends AS MATERIALIZED (SELECT DISTINCT read_id, strand, chrom_idx, length(seq) AS len, CAST(pos + {K - 1} AS BIGINT) AS "end" FROM hits JOIN reads USING (read_id)),
taken AS (SELECT read_id, strand, chrom_idx, len, min("end") AS "end" FROM ends GROUP BY ALL
  UNION SELECT t.read_id, t.strand, t.chrom_idx, t.len, (SELECT min(e."end") FROM ends e WHERE e.read_id = t.read_id AND e.strand = t.strand AND e.chrom_idx = t.chrom_idx AND e."end" >= t."end" + t.len)
  FROM taken t WHERE t."end" IS NOT NULL)
SELECT read_id, strand, chrom_idx, "end" FROM taken WHERE "end" IS NOT NULL""",
    "verify_windows": f"""WITH {DIAGONALS_SQL},
w AS (SELECT d.read_id, d.strand, d.chrom_idx, d.diagonal, CASE WHEN d.strand = '+' THEN r.seq ELSE reverse(translate(r.seq, 'ACGT', 'TGCA')) END AS read, greatest(d.diagonal, 0) AS window_start,
             least(d.diagonal + length(r.seq) + 10, g.seq_len) AS stop, g.seq FROM diagonals d JOIN reads r USING (read_id) JOIN genome g ON g.chrom_idx = d.chrom_idx)
SELECT read_id, strand, chrom_idx, diagonal, read, window_start, substr(seq, window_start + 1, greatest(stop - window_start, 0)) AS "window" FROM w""",
    "exact_hits": f"WITH {EXACT_SQL} SELECT read_id, hit_idx, chrom_idx, start, stop, strand, num_hits FROM exact",
    "locus_sequence": f"WITH {LOCI_SQL} SELECT read_id, hit_idx, locus_start, locus_stop, locus FROM loci",
    "locus_weight": f"WITH {WEIGHTS_SQL} SELECT chrom_idx, start, stop, strand, round(depth, 6) AS depth, round(weight, 6) AS weight FROM weights",
    "sam_render_seed": f"WITH {SAM_SQL} SELECT read_id, line FROM lines",
    "sam_parse_xa": f"WITH {PLACES_SQL} SELECT name, hit_idx, CAST(num_hits AS INTEGER) AS num_hits, chrom, start, stop, strand FROM placed",
    "sam_unaligned": f"WITH {EXACT_SQL} SELECT name, concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, qual) AS line FROM reads WHERE read_id NOT IN (SELECT read_id FROM exact)",
    "sam_header": f"""WITH {GENOME_SQL} SELECT 0 AS part, CAST(-1 AS BIGINT) AS chrom_idx, '@HD' || chr(9) || 'VN:1.0' || chr(9) || 'SO:unsorted' AS line
UNION ALL SELECT 1, chrom_idx, '@SQ' || chr(9) || 'SN:' || chrom || chr(9) || 'LN:' || seq_len FROM genome
UNION ALL SELECT 2, CAST(-1 AS BIGINT), '@PG' || chr(9) || 'ID:seqlattice'""",
    "place_digest": f"""WITH {EXACT_SQL}, t AS (SELECT read_id, hit_idx, hit_idx || name || start || stop || chr(10) AS t FROM exact),
c AS (SELECT read_id, hit_idx, length(t) AS n, i, ascii(substr(t, CAST(i AS BIGINT), 1)) AS b FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM t))
SELECT read_id, hit_idx, CAST(((max(n) + sum((n - i + 1) * b)) % 65521) * 65536 + (1 + sum(b)) % 65521 AS BIGINT) AS adler FROM c GROUP BY read_id, hit_idx""",
    "dcode_roundtrip": """WITH v AS (SELECT doc_id, (doc_id + 1) % 256 AS a, (doc_id * 3 + 5) % 256 AS b, (doc_id * 7 + 2) % 256 AS c, (doc_id * 11 + 9) % 256 AS d, (doc_id * 13) % 256 AS e FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'run.sam' ELSE 'run.DCODE' || lpad(printf('%X', (((a * 256 + b) * 256 + c) * 256 + d) * 256 + e), 16, '0') || '.sam' END AS file,
  CAST(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE a END AS INTEGER) AS threads, CAST(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE b END AS INTEGER) AS siter, CAST(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE c END AS INTEGER) AS giter,
  CAST(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE d END AS INTEGER) AS spseudo, CAST(CASE WHEN doc_id % 5 = 0 THEN -1 ELSE e END AS INTEGER) AS gpseudo FROM v""",
}
