"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, langid, licenses, mixing, ngram_join, ppm, quality, toxicity, urlfilter, vecdedup
from sievework.llm.common import crc_mod, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "license", "license_class")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


URL_RULES = tuple(map(urlfilter.parse, ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_lm_score": op6_lm_score,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_rules": op10_quality_rules,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9_SQL = rf"""
with recursive sized as (select doc_id, text, source, len({_WORDS})::bigint as size from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select source, source_size, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::bigint as weight from totals),
filled as (select *, 3 * source_size as cap, sum(source_size) over () as total,
  coalesce(sum(3 * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as left_weight from weighed),
level as (select arg_min(lvl, ratio) as fill from (select (total - before)::double / left_weight::double as lvl, 3.0::double * source_size / weight as ratio, cap, weight from filled) where lvl * weight <= cap),
targets as (select source, source_size, case when cap < fill * weight then cap::double else fill * weight end as target from filled, level),
rated as (select s.doc_id, s.text, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))), 1, 13))::bigint::double / 4503599627370496.0::double < rate - floor(rate))::bigint))::bigint as taken
from rated
"""


def _op10_sql() -> str:
    forms = sorted({f + end for w in quality.STOP_WORDS for f in (w, w.capitalize()) for end in ("", ".", ",")})
    stop = ", ".join("'" + w + "'" for w in forms)
    ratio = lambda m: re.sub(r"try_divide\((\w+), (\w+)\)", r"\1 / nullif(\2, 0)", m)
    broken = " or ".join(ratio(quality._sql(r)).replace("D)", "::double)").replace("D or", "::double or").replace("D,", "::double,") for r in quality.RULES)
    return rf"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
windows as (select k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] as g from (select k, w, unnest(range(1, len(w) - 3)) as i from docs)),
repeated as (select k, i from (select k, i, count(*) over (partition by k, g) as n from windows) where n > 1),
covered as (select k, count(distinct i + d)::bigint as n from repeated, range(5) r(d) group by k),
lines as (select k, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  len(list_filter(l, lambda x: rtrim(x, ' ').ends_with('...') or rtrim(x, ' ').ends_with('…')))::bigint as n_ellipsis_lines,
  len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 1) in ('-', '*', '•')))::bigint as n_bullet_lines
  from (select k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs)),
counts as (select docs.k, doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, n_dup_lines, n_lines, n_ellipsis_lines, n_bullet_lines,
  coalesce(covered.n, 0)::bigint as n_repeat_words,
  len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words,
  (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::bigint as n_digits
  from docs join lines using (k) left join covered using (k))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not ({broken}) as kept
from counts
"""


def _op5_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    fits = [(n, k, f"contains(line, '{'  '.join(['', *r.split(), ''])[1:-1]}')") for n, k, r in licenses.RULES]
    cases = lambda at: " ".join(f"when {x[2]} then '{x[at]}'" for x in fits)
    names = ", ".join(f"case when {fit} then '{n}' end" for n, _, fit in fits)
    return rf"""
with known(sentence, id) as (values {known}),
docs as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
sentences as (select k, generate_subscripts(p, 1) as i, unnest(p) as s from (select k, string_split(regexp_replace(replace(t, chr(13), chr(10)), '([.!?:])[ 	-
]+', '' || chr(10), 'g'), chr(10)) as p from docs)),
found as (select k, i, id from sentences join known on trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = sentence),
ids as (select k, count(*)::bigint as n, string_agg(id, ',' order by i) as ids, ' ' || string_agg(id, '  ' order by i) || ' ' as line from found group by k),
named as (select doc_id, coalesce(n, 0)::bigint as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(line, '') as line from docs left join ids using (k)),
listed as (select *, list_filter([{names}], lambda x: x is not null) as l from named)
select doc_id, n_sentences, sentence_ids, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ','), '') as licenses, case {cases(0)} end as license, case {cases(1)} end as license_class from listed
"""


ORACLE_SQL: dict[str, str] = {"op5_license_scan": _op5_sql(), "op9_mix_sources": OP9_SQL, "op10_quality_rules": _op10_sql()}
