"""Jobs on code points and Unicode files, and their queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codepoints as cps
from ..functions import numbers, ranges
from ..operators import candidates as cand
from ..operators import similarity as sim
from ..operators import weights as wt
from ..sources import unicode_files as ucd
from .catalog import lines, query, table

# Small inputs in the formats of the Unicode files.
UNICODE_DATA = """
0041;LATIN CAPITAL LETTER A;Lu;0;L
0061;LATIN SMALL LETTER A;Ll;0;L
0020;SPACE;Zs;0;WS
00E9;LATIN SMALL LETTER E WITH ACUTE;Ll;0;L
0391;GREEK CAPITAL LETTER ALPHA;Lu;0;L
0430;CYRILLIC SMALL LETTER A;Ll;0;L
0435;CYRILLIC SMALL LETTER IE;Ll;0;L
0660;ARABIC-INDIC DIGIT ZERO;Nd;0;AN
13A0;CHEROKEE LETTER A;Lu;0;L
1F100;DIGIT ZERO FULL STOP;No;0;EN
1D400;MATHEMATICAL BOLD CAPITAL A;Lu;0;L
1E2C0;WANCHO LETTER AA;Lo;0;L
2C60;LATIN CAPITAL LETTER L WITH DOUBLE BAR;Lu;0;L
4E00;<CJK Ideograph, First>;Lo;0;L
4E0F;<CJK Ideograph, Last>;Lo;0;L
AC00;<Hangul Syllable, First>;Lo;0;L
AC07;<Hangul Syllable, Last>;Lo;0;L
E000;<Private Use, First>;Co;0;L
F8FF;<Private Use, Last>;Co;0;L
malformed line
"""
SCRIPTS = """
# Scripts
0041..005A    ; Latin # L&  [26] A..Z
0061..007A    ; Latin
0030..0039    ; Common # Nd
0391..03A1    ; Greek
0400..0481    ; Cyrillic # L& [130]
0660..0669    ; Arabic
4E00..9FFF    ; Han
00E9          ; Latin
"""
PROPERTIES = """
0041..005A    ; XID_Start # L&
0061..007A    ; XID_Start
0430..0435    ; XID_Start
0030..0039    ; XID_Continue
0041..005A    ; XID_Continue
0430..0435    ; XID_Continue
00E9          ; XID_Continue # Ll
"""
IDNA = """
0000..002C    ; valid                  ;      ; NV8    # 1.1
0041          ; mapped                 ; 0061          # 1.1  A
0061..007A    ; valid                                  # 1.1
0430..0432    ; valid
00DF          ; deviation              ; 0073 0073
"""
CONFUSABLES = """
# confusables
0430 ;\t0061 ;\tMA\t# a
0391 ;\t0041 ;\tMA\t# upper-case target
0061 ;\t0062 ;\tMA\t# basic latin source
FB01 ;\t0066 0069 ;\tMA\t# several targets
0435 ;\t0065 ;\tMA
2C60 ;\t004C ;\tMA
05D0 ;\t05D1 ;\tMA\t# not latin
1D400 ;\t0041 ;\tMA
zzzz ;\t0041 ;\tMA
"""


def unicode_points(spark: SparkSession) -> DataFrame:
    return ucd.expand(ucd.parse_unicode_data(lines(spark, UNICODE_DATA)))


def coverage(spark: SparkSession) -> DataFrame:
    """A stand-in for the coverage of fonts: font k covers code points that k + 2 divides."""
    return unicode_points(spark).select("cp").crossJoin(spark.range(5).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("family"), "id")).where(F.col("cp") % (F.col("id") + 2) == 0).select("cp", "family")


def text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code point of the documents, with its character and how often it occurs."""
    return ucd.characters_of(cps.count_code_points(table(spark, sf_dir, "documents"), "text"))


# SQL of the small inputs

RAW = "with raw(cp, name, gc) as (values (65, 'LATIN CAPITAL LETTER A', 'Lu'), (97, 'LATIN SMALL LETTER A', 'Ll'), (233, 'LATIN SMALL LETTER E WITH ACUTE', 'Ll'), (913, 'GREEK CAPITAL LETTER ALPHA', 'Lu'), (1072, 'CYRILLIC SMALL LETTER A', 'Ll'), (1077, 'CYRILLIC SMALL LETTER IE', 'Ll'), (1632, 'ARABIC-INDIC DIGIT ZERO', 'Nd'), (5024, 'CHEROKEE LETTER A', 'Lu'), (127232, 'DIGIT ZERO FULL STOP', 'No'), (119808, 'MATHEMATICAL BOLD CAPITAL A', 'Lu'), (123584, 'WANCHO LETTER AA', 'Lo'), (11360, 'LATIN CAPITAL LETTER L WITH DOUBLE BAR', 'Lu')), points as (select * from raw union all select range::int, 'CJK Ideograph', 'Lo' from range(19968, 19984) union all select range::int, 'Hangul Syllable', 'Lo' from range(44032, 44040)), cov as (select cp, 'F' || id as family from points, range(5) t(id) where cp % (id + 2) = 0)"
TEXT = "with c as (select unnest(string_split(text, '')) as ch from documents), points as (select ch, unicode(ch) as cp, count(*) as n from c where ch <> '' group by ch)"


def case(table_: tuple[tuple[int, int, str], ...], otherwise: str) -> str:
    return "case " + " ".join(f"when cp between {a} and {b} then '{label}'" for a, b, label in table_) + f" else {otherwise} end"


# Sources


@query(RAW + " select cp, name, gc from points")
def S07_unicode_data(spark, sf_dir):
    return unicode_points(spark)


@query("select * from (values (65, 90, 'Latin'), (97, 122, 'Latin'), (48, 57, 'Common'), (913, 929, 'Greek'), (1024, 1153, 'Cyrillic'), (1632, 1641, 'Arabic'), (19968, 40959, 'Han'), (233, 233, 'Latin')) t(lo, hi, script)")
def S08_scripts(spark, sf_dir):
    return ucd.parse_scripts(lines(spark, SCRIPTS))


@query("select * from (values (65, 90), (97, 122), (1072, 1077)) t(lo, hi)")
def S09_property(spark, sf_dir):
    return ucd.parse_property(lines(spark, PROPERTIES), "XID_Start")


@query("select * from (values (0, 44), (97, 122), (1072, 1074)) t(lo, hi)")
def S10_idna_valid(spark, sf_dir):
    return ucd.parse_idna(lines(spark, IDNA))


@query("select * from (values ('U+0391', 913, 'a'), ('U+0430', 1072, 'a'), ('U+0435', 1077, 'e'), ('U+2C60', 11360, 'l'), ('U+1D400', 119808, 'a')) t(source_cp, cp, target)")
def S12_confusable_pairs(spark, sf_dir):
    return ucd.confusable_pairs(lines(spark, CONFUSABLES))


@query("select * from (values (null, 5::bigint), ('basic latin source', 1), ('several target characters', 1), ('target not a-z or 0-9', 1)) t(reason, n)")
def C02_confusable_counts(spark, sf_dir):
    return cand.count_by(ucd.parse_confusables(lines(spark, CONFUSABLES)), "reason")


# Functions


@query(TEXT + " select cp, 'U+' || case when length(hex(cp)) < 4 then lpad(hex(cp), 4, '0') else hex(cp) end as u_plus, cp as back, case when cp <= 65535 then 'BMP' else 'SMP' end as plane, (cp between 65 and 90) or (cp between 97 and 122) or (cp between 48 and 57) as latin from points")
def F01_code_points(spark, sf_dir):
    u = cps.to_u_plus(F.col("cp"))
    return text_points(spark, sf_dir).select("cp", u.alias("u_plus"), cps.from_u_plus(u).alias("back"), cps.plane(F.col("cp")).alias("plane"), cps.is_basic_latin(F.col("cp")).alias("latin"))


@query(TEXT + f", p as (select * from points) select cp, {case(ranges.EXCLUDED, 'null')} as range from p")
def F09_excluded_range(spark, sf_dir):
    return text_points(spark, sf_dir).select("cp", ranges.excluded_range(F.col("cp")).alias("range"))


@query(RAW + f" select cp, {case(ranges.BLOCK_SCRIPTS, 'case ' + ' '.join(f'when contains(name, {w!r}) then {s!r}' for w, s in ranges.NAME_SCRIPTS) + ' else ' + repr('Other') + ' end')} as script from points")
def F06_block_script(spark, sf_dir):
    return unicode_points(spark).select("cp", ranges.block_script(F.col("cp"), F.col("name")).alias("script"))


# All 1,114,112 code points; a label's count, least, greatest and sum tell its ranges from any others.
EVERY = "select {0}, count(*) as n, min(cp) as least, max(cp) as greatest, sum(cp)::bigint as total from ({1}) group by {0}"


def _every(spark: SparkSession) -> DataFrame:
    return spark.range(0x110000).select(F.col("id").cast("int").alias("cp"))


def _summed(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.min("cp").alias("least"), F.max("cp").alias("greatest"), F.sum("cp").alias("total"))


@query(EVERY.format("script", "select cp, " + case(ranges.SUMMARY_SCRIPTS, "'Other'") + " as script from (select range::int as cp from range(1114112)) t"))
def F07_summary_script(spark, sf_dir):
    return _summed(_every(spark).withColumn("script", ranges.summary_script(F.col("cp"))), "script")


@query(EVERY.format("script", "select cp, " + case(ranges.REPORT_GROUPS, "case when cp > 65535 then 'Other SMP' else 'Other BMP' end") + " as script from (select range::int as cp from range(1114112)) t"))
def F08_report_group(spark, sf_dir):
    return _summed(_every(spark).withColumn("script", ranges.report_group(F.col("cp"))), "script")


@query("with p as (select range::int as cp from range(1114112)), t(ord, lo, hi, label) as (values " + ", ".join(f"({k}, {a}, {b}, '{x}')" for k, (a, b, x) in enumerate(ranges.SUMMARY_SCRIPTS)) + ") " + EVERY.format("label", "select p.cp, arg_min(label, ord) as label from p left join t on p.cp between lo and hi group by p.cp"))
def J13_first_range(spark, sf_dir):
    return _summed(ranges.first_range(_every(spark), ranges.range_table(spark, ranges.SUMMARY_SCRIPTS)), "label")


@query("select conv_id, turn, string_agg(hex(unicode(c)), '_' order by i) as hex_name from (select conv_id, turn, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from conversations) where c <> '' group by all")
def F14_hex_name(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("length(text) > 0").select("conv_id", "turn", cps.hex_name(F.col("text")).alias("hex_name"))


@query("select l_orderkey, l_linenumber, floor((l_discount - 0.05) * l_extendedprice / 1000 * 10000 + 0.5) / 10000 as rounded, greatest(0, least(1, l_discount * 12 - 0.1)) as clamped, case when l_quantity > 0 and l_tax > 0 then greatest(l_quantity, l_tax) / least(l_quantity, l_tax) end as ratio from lineitem")
def F15_rounding(spark, sf_dir):
    x = (F.col("l_discount") - 0.05) * F.col("l_extendedprice") / 1000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(x).alias("rounded"), numbers.clamp(F.col("l_discount") * 12 - 0.1).alias("clamped"), numbers.ratio(F.col("l_quantity"), F.col("l_tax")).alias("ratio"))


@query("select event_type, round(quantile_cont(value, 0.95), 6) as p95, round(median(value), 6) as median, round(avg(value), 6) as mean, count(*) as n from events group by event_type")
def F16_percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(numbers.percentile_or_zero(F.col("value"), 0.95), 6).alias("p95"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(TEXT + ", t as (select sum(n) filter (cp > 127) as a, sum(n) as b from points) select printf('%.1f%%', 100.0 * a / b) as share, repeat('#', ceil(a / 5000.0)::int) as bar from t")
def F21_formatted(spark, sf_dir):
    from ..functions.labels import bar

    t = text_points(spark, sf_dir).agg(F.sum(F.when(F.col("cp") > 127, F.col("n"))).alias("a"), F.sum("n").alias("b"))
    return t.select(numbers.percent(F.col("a"), F.col("b")).alias("share"), bar(F.col("a"), 5000).alias("bar"))


# Filters, joins and counts on code points


def _reasons(spark: SparkSession, inverted: bool) -> DataFrame:
    existing = ucd.parse_confusables(lines(spark, CONFUSABLES)).where("reason is null").select("cp")
    return cand.filter_reasons(unicode_points(spark), existing, coverage(spark), inverted)


REASONS = RAW + f", known(cp) as (values (913), (1072), (1077), (11360), (119808)), n as (select cp, count(distinct family) as font_coverage from cov group by cp), q as (select p.*, coalesce(font_coverage, 0) as font_coverage, k.cp is not null as seen, (p.cp between 65 and 90) or (p.cp between 97 and 122) or (p.cp between 48 and 57) as latin, {case(ranges.EXCLUDED, 'null').replace('cp between', 'p.cp between')} as range from points p left join known k on k.cp = p.cp left join n on n.cp = p.cp)"


@query(REASONS + " select reason, count(*) as n from (select case when latin then 'latin target' when seen then 'existing source' when range is not null then 'excluded range' when font_coverage = 0 then 'no font' end as reason from q) group by reason")
def W02_candidate_reasons(spark, sf_dir):
    return cand.count_by(_reasons(spark, False), "reason")


@query(REASONS + f", z as (select cp, name, font_coverage, case when latin then 'x' when seen then 'x' when range is not null then 'x' when font_coverage = 0 then 'x' end as reason from q) select 'U+' || lpad(hex(cp), greatest(4, length(hex(cp)))::int, '0') as codepoint, {case(ranges.BLOCK_SCRIPTS, 'case ' + ' '.join(f'when contains(name, {w!r}) then {s!r}' for w, s in ranges.NAME_SCRIPTS) + ' else ' + repr('Other') + ' end')} as script, font_coverage from z where reason is null")
def C03_candidates(spark, sf_dir):
    return cand.candidates(_reasons(spark, False)).select("codepoint", "script", "font_coverage")


@query(REASONS + " select range, count(*) as n, sum(font_coverage)::bigint as fonts from (select *, case when range is null then 'x' when latin then 'x' when seen then 'x' end as reason from q) where reason is null group by range")
def W03_excluded_candidates(spark, sf_dir):
    return _reasons(spark, True).where("reason is null").groupBy("range").agg(F.count("*").alias("n"), F.sum("font_coverage").alias("fonts"))


@query(RAW + ", s(lo, hi, script) as (values (65, 90, 'Latin'), (97, 122, 'Latin'), (48, 57, 'Common'), (913, 929, 'Greek'), (1024, 1153, 'Cyrillic'), (1632, 1641, 'Arabic'), (19968, 40959, 'Han'), (233, 233, 'Latin')), f(ord, family, script, lo, hi) as (values " + ", ".join(f"({k}, '{n}', '{s}', {a}, {b})" for k, (n, ss, rr) in enumerate(ranges.FAMILIES) for s in ss for a, b in rr) + "), n as (select cp, count(distinct family) as font_coverage from cov group by cp) select f.ord, f.family, p.cp, p.name, p.gc, n.font_coverage from points p join s on p.cp between s.lo and s.hi join f on f.script = s.script and p.cp between f.lo and f.hi join n on n.cp = p.cp")
def W04_script_sets(spark, sf_dir):
    return cand.script_set(unicode_points(spark), ucd.parse_scripts(lines(spark, SCRIPTS)), coverage(spark), ranges.families(spark))


PROPS = "select cp, exists(select 1 from (values (65, 90), (97, 122), (1072, 1077)) t(lo, hi) where cp between lo and hi) as xid_start, exists(select 1 from (values (48, 57), (65, 90), (1072, 1077), (233, 233)) t(lo, hi) where cp between lo and hi) as xid_continue, exists(select 1 from (values (0, 44), (97, 122), (1072, 1074)) t(lo, hi) where cp between lo and hi) as idna_pvalid, false as tr39_allowed from points"


def _annotated(spark: SparkSession, points: DataFrame) -> DataFrame:
    found = {"xid_start": ucd.parse_property(lines(spark, PROPERTIES), "XID_Start"), "xid_continue": ucd.parse_property(lines(spark, PROPERTIES), "XID_Continue"), "idna_pvalid": ucd.parse_idna(lines(spark, IDNA)), "tr39_allowed": ucd.parse_property(lines(spark, PROPERTIES), "Allowed")}
    return wt.annotate(points, found)


@query(TEXT + " " + PROPS)
def J12_annotate_properties(spark, sf_dir):
    return _annotated(spark, text_points(spark, sf_dir).select("cp"))


@query(TEXT + f" select count(*) as total, count(*) filter (xid_start) as xid_start, count(*) filter (xid_continue) as xid_continue, count(*) filter (idna_pvalid) as idna_pvalid, count(*) filter (tr39_allowed) as tr39_allowed, count(*) filter (xid_start and xid_continue and idna_pvalid and tr39_allowed) as every from ({PROPS})")
def A17_property_counts(spark, sf_dir):
    return wt.property_counts(_annotated(spark, text_points(spark, sf_dir).select("cp")))


@query(TEXT + f" select script, count(*) as characters, sum(n)::bigint as n from (select n, {case(ranges.BLOCK_SCRIPTS, repr('Other'))} as script from points) group by script")
def A18_text_scripts(spark, sf_dir):
    return text_points(spark, sf_dir).groupBy(ranges.block_script(F.col("cp"), F.lit("")).alias("script")).agg(F.count("*").alias("characters"), F.sum("n").alias("n"))


@query(RAW + " select avg(n) as mean_fonts, count(*) filter (n = 0) as uncovered, sum(n)::bigint as jobs, count(*) * 5 as brute_force from (select p.cp, count(distinct family) as n from points p left join cov on cov.cp = p.cp group by p.cp)")
def A23_coverage_statistics(spark, sf_dir):
    return cand.coverage_statistics(unicode_points(spark), coverage(spark), 5)


@query(RAW + ", c as (select cp, family from cov where family <> 'F4') select cp, family, false as fallback from c union all select p.cp, f, true from points p, (values ('X'), ('Y')) t(f) where not exists (select 1 from c where c.cp = p.cp)")
def J09_render_jobs(spark, sf_dir):
    fonts = spark.range(4).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("family"))
    return cand.render_jobs(unicode_points(spark), coverage(spark), fonts, spark.sql("select * from values ('X'), ('Y') as t(family)"))


# Generators


@query("with a as (select chr((97 + range)::int) as c from range(26) union all select chr((65 + range)::int) from range(26) union all select chr((48 + range)::int) from range(10)) select x.c || y.c as sequence, [x.c, y.c] as chars, 2 as length from a x, a y")
def G01_sequences(spark, sf_dir):
    return cand.sequences(spark)


@query("with s(ord, script) as (values " + ", ".join(f"({k}, '{n}')" for k, (n, _, _) in enumerate(ranges.FAMILIES)) + ") select case when a.script = 'Han' then b.script else a.script end as script_a, case when a.script = 'Han' then a.script else b.script end as script_b from s a, s b where a.ord < b.ord")
def G03_script_pairs(spark, sf_dir):
    return _script_pairs(spark).select("script_a", "script_b")


def _script_pairs(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({k}, '{n}')" for k, (n, _, _) in enumerate(ranges.FAMILIES))
    return sim.script_pairs(spark.sql(f"select * from values {rows} as t(ord, script)"))


@query("with s(ord, script) as (values " + ", ".join(f"({k}, '{n}')" for k, (n, _, _) in enumerate(ranges.FAMILIES)) + "), f(rank, x, y) as (values (1, 'Cyrillic', 'Latin'), (2, 'Greek', 'Latin'), (3, 'Han', 'Katakana')), p as (select case when a.script = 'Han' then b.script else a.script end as script_a, case when a.script = 'Han' then a.script else b.script end as script_b from s a, s b where a.ord < b.ord) select script_a, script_b, rank from p left join f on least(script_a, script_b) = x and greatest(script_a, script_b) = y")
def O07_script_pair_order(spark, sf_dir):
    first = spark.sql("select * from values (1, 'Latin', 'Cyrillic'), (2, 'Greek', 'Latin'), (3, 'Katakana', 'Han') as t(rank, script_a, script_b)")
    return sim.order_script_pairs(_script_pairs(spark), first)


@query(TEXT + ", t(target) as (select chr((97 + range)::int) from range(26) union all select chr((48 + range)::int) from range(10)) select ch as source, target from points, t where cp > 127")
def G02_source_targets(spark, sf_dir):
    targets = spark.range(36).select(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), F.col("id").cast("int") + 1, F.lit(1)).alias("target"))
    return cand.source_targets(text_points(spark, sf_dir).where("cp > 127").select(F.col("ch").alias("source")), targets)
