"""One query per operator of this subpackage, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.chat import digests, format_chats
from touchline.llm.complement import pack_documents
from touchline.llm.fingerprints import compare_with_next
from touchline.llm.fixity import audit, warc_record, with_offsets
from touchline.llm.infill import digests as infill_digests
from touchline.llm.language import learn, predict
from touchline.llm.manifest import leaf_digest, manifest, verify
from touchline.llm.mixing import calibrated, draw, topic, words
from touchline.llm.neighbours import nearest
from touchline.llm.packing import pack
from touchline.llm.simhash import near_duplicates
from touchline.llm.token_counts import count_tokens
from touchline.llm.token_files import token_file_digests
from touchline.session import staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_file_digests(
        _table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(
        count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    )


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(
        _table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


#: Exponents that flatten sources and topics, and languages a little less.
MIX_TARGETS: dict[str, float] = {"source": 0.5, "lang": 0.7, "topic": 0.5}


def mix_dimensions() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    rows = calibrated(docs, mix_dimensions(), MIX_TARGETS, tokens=words(F.col("text")))
    return rows.where(draw(F.col("doc_id"), F.col("text")) < F.col("_probability")).select(
        "doc_id", "source", "lang", topic(F.col("text")).alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"),
    )


def op5_warc_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Two replicas of the WARC archives of all pages, 512 page ids an archive.

    The second has what storage does to files: by the page id some records have one
    character altered in the middle, some are cut to half, some are gone. So the records
    behind a cut or a gap lie elsewhere in it; ids are those in the record headers.
    """
    pages = _table(spark, sf, "pages").select(
        "page_id", F.expr("page_id div 512").alias("archive"), warc_record(F.col("url"), F.col("html")).alias("r")
    )
    harmed = F.expr("""case coalesce(page_id, 0) % 97
        when 13 then concat(left(r, length(r) div 2), '~', substring(r, length(r) div 2 + 2))
        when 31 then left(r, length(r) div 2) else r end""")

    def replica(record: Column, name: str) -> DataFrame:
        rows = pages.select("page_id", "archive", record.alias("r")).select(
            "page_id", "archive", F.octet_length("r").cast("bigint").alias("length"), F.sha2("r", 256).alias("digest"),
            F.regexp_extract("r", "WARC-Record-ID: <([^>]*)>", 1).alias("record"),
        )
        if name == "second":
            rows = rows.where("coalesce(page_id, 0) % 97 != 59")
        return staged(with_offsets(rows, "page_id", "digest"), name)

    return audit(replica(F.col("r"), "first"), replica(harmed, "second"), record_col="record")


#: Documents that nothing is learned from; rows without an id are held out as well.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, true)"


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    network = learn(docs.where(f"not {HELD_OUT}"))
    return predict(docs, network).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


#: Conversation -1 of op7: a user and an assistant row whose texts look like another template.
_MARKED = """select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text
from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"""


def op7_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(turns.unionByName(spark.sql(_MARKED))))


def op8_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return compare_with_next(_table(spark, sf, "documents"))


def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(_table(spark, sf, "embeddings"), "vec_id % 50 = 0")


def op11_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill_digests(_table(spark, sf, "documents"))


#: What a leaf of the manifest digests, and the documents whose text is tampered with.
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = "crc32(cast(doc_id as string)) % 3 = 0"


def op12_manifest(spark: SparkSession, sf: str) -> DataFrame:
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.when(F.expr(TAMPERED), lowered).otherwise(F.col("text"))
    claimed = leaf_digest(*[F.col(c) for c in MANIFEST_FIELDS[:-1]], text)
    grown = manifest(_table(spark, sf, "documents"), MANIFEST_FIELDS, carry={"claimed": claimed})
    return verify(grown, "claimed").drop("claimed")


def op13_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def importable(query: Query) -> Query:
    """``query``, with Python workers on this machine able to import the library.

    They are not where a driver started elsewhere has only its own path set; on a cluster
    the library is installed or sent with ``--py-files``.
    """

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        root = str(Path(__file__).resolve().parents[2])
        env = spark.sparkContext.environment
        known = env.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))
        return query(spark, *args)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: importable(f)
    for f in (
        op1_token_files, op2_packing, op3_token_counts, op4_mixing, op5_warc_audit, op6_language, op7_chat_format, op8_minhash, op9_simhash, op10_neighbours,
        op11_infill, op12_manifest, op13_best_fit,
    )
}

_OP7_SQL = """
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n as (
    select *, coalesce(role = lag(role) over w, false) as merged, replace(text, '⟦', '⟦q') as shown
    from t window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), ''
        order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
        filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(case when merged then 2 + length(shown)
        else 7 + length(replace(role, '⟦', '⟦q')) + length(shown) end) as bigint) as formatted_chars
from n group by conv_id
"""

# Raking as a recursion of 60 sweeps over the cells; the rate by setting cells aside in the
# order of their factors.
_OP4_SQL = r"""
with recursive d as (
    select doc_id, source, lang, case when text like '%icense%' then 'license' when text like '%@%' then 'contact'
            when text like '% | %' then 'table' else 'prose' end as topic,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n, text
    from documents
), c as (
    select source, lang, topic, sum(n)::double as t from d group by all
), m as (
    select *, pow(sum(t) over (partition by source), 0.5) as gs, pow(sum(t) over (partition by lang), 0.7) as gl,
        pow(sum(t) over (partition by topic), 0.5) as gt, sum(t) over () as total from c
), g as (
    select source, lang, topic, t, total,
        total * gs / (select sum(x) from (select distinct source, gs as x from m)) as ts,
        total * gl / (select sum(x) from (select distinct lang, gl as x from m)) as tl,
        total * gt / (select sum(x) from (select distinct topic, gt as x from m)) as tt
    from m
), ipf as (
    select 0 as k, *, t as w from g
    union all
    select k + 1, source, lang, topic, t, total, ts, tl, tt, w * tt / sum(w) over (partition by topic) from (
        select *  replace (w * tl / sum(w) over (partition by lang) as w) from (
            select * replace (w * ts / sum(w) over (partition by source) as w) from ipf where k < 60))
), f as (
    select source, lang, topic, t, total, w / t as factor from ipf where k = 60
), s as (
    select *, coalesce(sum(t) over o, 0) as full_, sum(w) over r as open_ from (select *, factor * t as w from f)
    window o as (order by factor desc, source, lang, topic rows between unbounded preceding and 1 preceding),
        r as (order by factor desc, source, lang, topic rows between current row and unbounded following)
), rate as (
    select (0.5 * total - full_) / open_ as rate from s
    where factor * (0.5 * total - full_) / open_ <= 1 order by factor desc, source, lang, topic limit 1
)
select doc_id, source, lang, topic, n as n_tokens, round(factor, 6) as weight,
    round(least(1.0, factor * (select rate from rate)), 6) as probability
from d join f using (source, lang, topic)
where ('0x' || substr(md5(cast(doc_id as varchar)), 1, 13))::bigint / 4503599627370496.0
    < least(1.0, factor * (select rate from rate))
"""

_OP5_SQL = r"""
with p as (
    select page_id, page_id // 512 as archive, coalesce(url, '') as u, coalesce(html, '') as h from pages
), w as (
    select page_id, archive, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
        || 'WARC-Record-ID: <urn:md5:' || md5(u || chr(10) || h) || '>' || chr(13) || chr(10)
        || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
        || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
        || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h
        || chr(13) || chr(10) || chr(13) || chr(10) as r
    from p
), d as (
    select page_id, archive, strlen(r) as length_a, sha256(r) as digest_a,
        case coalesce(page_id, 0) % 97 when 13 then left(r, length(r) // 2) || '~' || substring(r, length(r) // 2 + 2)
            when 31 then left(r, length(r) // 2) else r end as damaged
    from w
), o as (
    select *, coalesce(sum(length_a) over (partition by archive order by page_id, digest_a
        rows between unbounded preceding and 1 preceding), 0) as pos,
        coalesce(sum(case when page_id % 97 = 59 then 0 else strlen(damaged) end) over (
        partition by archive order by page_id, digest_a rows between unbounded preceding and 1 preceding), 0) as pos_b
    from d
)
select archive, cast(pos as bigint) as "offset",
    case when page_id % 97 = 59 then 'missing' else 'altered' end as problem,
    case when page_id % 97 = 59 then null else cast(pos_b as bigint) end as offset_b,
    cast(length_a as bigint) as length_a,
    case when page_id % 97 = 59 then null else cast(strlen(damaged) as bigint) end as length_b, digest_a,
    case when page_id % 97 = 59 then null else sha256(damaged) end as digest_b
from o where page_id % 97 = 59 or sha256(damaged) != digest_a
"""

_OP11_SQL = r"""
with d as (
    select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), u as (
    select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as units, ('0x' || h[1:8])::bigint as h1,
        ('0x' || h[9:16])::bigint as h2, ('0x' || h[25:32])::bigint as h4 from d
), c as (
    select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
        greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b from u
), s as (
    select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end as form,
        coalesce(array_to_string(units[1:a], ''), '') as p, coalesce(array_to_string(units[a + 1:b], ''), '') as m,
        coalesce(array_to_string(units[b + 1:n], ''), '') as s
    from c
)
select doc_id, cast(n as bigint) as n, form, cast(case when form != 'plain' then length(p) end as bigint) as prefix_chars,
    cast(case when form != 'plain' then length(m) end as bigint) as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from s
"""



def _op12_sql(lang_levels: int = 7, root_levels: int = 3) -> str:
    """Levels as common table expressions, one after the other: enough for 8 ** 7 documents a language."""

    def grow(name: str, levels: int) -> list[str]:
        """Runs and nodes of each level above ``name``0 (tree, i, d, c: nodes of the tree)."""
        out = []
        for k in range(levels):
            out.append(f"{name}r{k} as materialized (select tree, i // 8 as r, list(d order by i) as ds, any_value(c) as c"
                       f" from {name}{k} group by all)")
            out.append(f"{name}{k + 1} as (select tree, r as i, case when c = 1 then ds[1] else"
                       f" sha256(array_to_string(ds, '')) end as d, (c + 7) // 8 as c from {name}r{k})")
        return out

    def climb(name: str, rows: str, levels: int) -> list[str]:
        """Proof and folded digest of ``rows``0 (tree, i, f, p, ..) level by level."""
        return [
            f"{rows}{k + 1} as (select w.* replace (i // 8 as i, case when c = 1 then f else"
            " sha256(array_to_string(ds[1:i % 8], '') || f || array_to_string(ds[i % 8 + 2:8], '')) end as f,"
            " p || case when c = 1 then '' else array_to_string(ds[1:i % 8], '') || array_to_string(ds[i % 8 + 2:8], '') end as p)"
            f" from {rows}{k} w join {name}r{k} r on w.tree = r.tree and w.i // 8 = r.r)"
            for k in range(levels)
        ]

    def field(column: str) -> str:
        return f"coalesce(strlen(cast({column} as varchar)) || ':' || cast({column} as varchar), '-')"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = " || ".join(map(field, MANIFEST_FIELDS))
    tampered = " || ".join(map(field, [*MANIFEST_FIELDS[:-1], low]))
    parts = [
        f"docs as (select doc_id, coalesce('=' || lang, '') as tree, sha256({plain}) as leaf, sha256({tampered}) as low"
        " from documents)",
        "placed as materialized (select *, row_number() over w - 1 as i, count(*) over (partition by tree) as c from docs"
        " window w as (partition by tree order by doc_id nulls first, leaf))",
        "l0 as (select tree, i, leaf as d, c from placed)",
        *grow("l", lang_levels),
        f"s0 as (select '' as tree, row_number() over (order by encode(tree)) - 1 as i, d, count(*) over () as c, tree as lang from l{lang_levels})",
        *grow("s", root_levels),
        # CRC-32 of the decimal id, which is no function there: bit by bit.
        "crc as (select doc_id, cast(doc_id as varchar) as t, 0 as k, 4294967295::bigint as v from docs union all"
        " select doc_id, t, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from (select *,"
        " case when k % 8 = 0 then xor(v, ord(t[k // 8 + 1])) else v end as x from crc where k < 8 * strlen(t)))",
        "hit as (select distinct doc_id from crc where k = 8 * strlen(t) and xor(v, 4294967295) % 3 = 0)",
        "lw0 as (select doc_id, leaf, tree as own, tree, i, case when doc_id in (from hit) then low else leaf end as f, '' as p from placed)",
        *climb("l", "lw", lang_levels),
        f"sw0 as (select w.* exclude (tree, i), '' as tree, s.i, s.d as subroot from lw{lang_levels} w join s0 s on w.own = s.lang)",
        *climb("s", "sw", root_levels),
    ]
    return "with recursive " + ",\n".join(parts) + f"""
select w.doc_id, w.leaf, w.subroot, r.d as root, sha256(w.p) as proof_sha256, w.f as folded_root, w.f = r.d as verified
from sw{root_levels} w join s{root_levels} r on true"""


ORACLE: dict[str, str] = {
    "op4_mixing": _OP4_SQL, "op5_warc_audit": _OP5_SQL, "op7_chat_format": _OP7_SQL, "op11_infill": _OP11_SQL,
    "op12_manifest": _op12_sql(),
}
