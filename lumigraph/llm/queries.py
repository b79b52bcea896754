"""The queries of the text operators, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lumigraph.llm.chat import format_chats
from lumigraph.llm.common import new_path, read_table
from lumigraph.llm.decontamination import find_contamination
from lumigraph.llm.fingerprints import compare_edits
from lumigraph.llm.line_dedup import dedup_lines
from lumigraph.llm.mixing import mix
from lumigraph.llm.near_dup import near_duplicates
from lumigraph.llm.secrets import find_secrets
from lumigraph.llm.token_counts import count_tokens
from lumigraph.llm.token_output import read_tokens, write_tokens
from lumigraph.llm.toxicity import score_toxicity


def op1_line_dedup(spark, sf_dir):
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark, sf_dir):
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat_formatting(spark, sf_dir):
    return format_chats(read_table(spark, sf_dir, "conversations"))


def op3_toxicity(spark, sf_dir):
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def token_digests(docs):
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_output(spark, sf_dir):
    return token_digests(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_fingerprints(spark, sf_dir):
    out = compare_edits(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_secret_scan(spark, sf_dir):
    return find_secrets(read_table(spark, sf_dir, "documents")).drop("finding")


def op9_decontamination(spark, sf_dir):
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=2)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_token_output": op4_token_output,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACE})"

ORACLES = {
    "op1_line_dedup": f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as xs from documents),
lines as (select doc_id, i, xs[i] as line from (select doc_id, xs, unnest(generate_series(1, len(xs))) as i from docs)),
keyed as (select doc_id, i, line, {_KEY} as key from lines),
common as (select key, max(doc_id) as home from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
select doc_id, count(*) as n_lines, count(*) filter (where doc_id < home) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where home is null or doc_id >= home), '')) as kept_sha256
from keyed left join common using (key) group by doc_id""",
    "op2_mixing": r"""
with docs as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents),
sources as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from docs group by source),
steps as (select *, 3 * source_size as most,
  sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as remain,
  sum(weight) over (order by 3 * source_size / weight desc, source desc nulls first rows unbounded preceding) as open from sources),
marked as (select *, most * open <= remain * weight as is_full from steps),
targets as (select source, source_size, case when is_full then most::double else weight * ((sum(source_size) over () - coalesce(sum(most) filter (where is_full) over (), 0))::double
  / (sum(weight) filter (where not is_full) over ())::double) end as target from marked),
taken as (select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as whole,
  sum(d.size) over (partition by d.source order by d.h) as upto, sum(d.size) over (partition by d.source, d.h) as own
  from docs d join targets t on d.source is not distinct from t.source),
split as (select *, greatest(0, target - whole * source_size) - (upto - own) as rest from taken)
select doc_id, size::bigint as size, source_size, target, (size * (whole + case when rest >= own or (rest >= 0 and abs(rest - own) < rest) then 1 else 0 end))::bigint as taken from split""",
    "op5_chat_formatting": r"""
with turns as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, list({'r': role, 't': text} order by pos) as xs from turns group by conv_id),
ends as (select xs, n, min(conv_id) as conv_id from convs group by xs, n),
inner_prefixes as (select distinct xs[1:k] as xs from (select xs, unnest(generate_series(1, n - 1)) as k from convs))
select e.conv_id, e.n as n_turns, (select string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' order by pos) from turns where turns.conv_id = e.conv_id) as rendered
from ends e anti join inner_prefixes p on e.xs = p.xs""",
}
