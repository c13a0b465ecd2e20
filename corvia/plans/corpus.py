"""Queries on text, corpora, splits and quality constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvia.functions import text as X
from corvia.operators import corpus as C
from corvia.plans.registry import Tables, query


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_mask(text: str, patterns: dict[str, str]) -> str:
    for kind, p in patterns.items():
        text = f"regexp_replace({text}, {q(p)}, '[{kind}]', 'g')"
    return text


def sql_kinds(text: str, patterns: dict[str, str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(f"case when regexp_matches({text}, {q(p)}) then {q(k)} end" for k, p in patterns.items()) + "], lambda x: x is not null)), ',')"


@query(f"select doc_id, {sql_mask('text', X.IDENTIFIERS)} as masked from documents")
def mask_identifiers(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.masked(F.col("text")).alias("masked"))


@query(f"select doc_id, kinds from (select doc_id, {sql_kinds('text', X.IDENTIFIERS)} as kinds from documents) where kinds <> ''")
def identifier_kinds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.kinds(F.col("text")), ",").alias("kinds")).where("kinds <> ''")


@query(f"select doc_id, kinds from (select doc_id, {sql_kinds('text', X.CREDENTIALS)} as kinds from documents) where kinds <> ''")
def credential_kinds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.kinds(F.col("text"), X.CREDENTIALS), ",").alias("kinds")).where("kinds <> ''")


@query("select doc_id, regexp_replace(" + sql_mask("replace(text, source, '[organization]')", {k: X.IDENTIFIERS[k] for k in ("email", "phone")}) + r", '(?i)((?:contact|author|name)\s*:\s*)[^\s,;.]+', '\1[name]', 'g') as text from documents")
def deidentify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.deidentified(F.col("text"), F.col("source")).alias("text"))


@query(f"select doc_id, translate(text, {q(X.SPACES + X.WIDE + X.ZERO_WIDTH)}, {q(' ' * len(X.SPACES) + X.NARROW)}) as text from documents")
def normalized_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalized(F.col("text")).alias("text"))


@query(r"select doc_id, substr(regexp_replace(regexp_replace(text, '\A\s+|\s+\z', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), 1, 400) as text from documents")
def compact_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.compact(F.col("text")).alias("text"))


@query(r"select doc_id, len(regexp_extract_all(text, '(?i)(?:not|nicht|pas|no) [a-zà-ÿ]+'))::int as negated from documents where regexp_matches(text, '(?i)(?:not|nicht|pas|no) [a-zà-ÿ]+')")
def negated_hits(t: Tables) -> DataFrame:
    rx = r"(?i)(?:not|nicht|pas|no) [a-zà-ÿ]+"
    return t.documents.where(F.col("text").rlike(rx)).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("negated"))


@query("select gram, count(*) as n, count(distinct item_id) as items from (select item_id, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) as gram from benchmark) group by gram")
def char_bigrams(t: Tables) -> DataFrame:
    grams = t.benchmark.select("item_id", F.explode(X.bigrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


@query("select doc_id, length(text)::int as chars from documents where length(text) >= 120")
def min_length_docs(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") >= 120).select("doc_id", F.length("text").alias("chars"))


@query("""with recursive r as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, text) as n from conversations),
b as (select conv_id, n, turn, least(200, 500, length(text)) as used, least(200, 500, length(text)) as total, text from r where n = 1
 union all select r.conv_id, r.n, r.turn, least(200, 500 - b.total, length(r.text)), b.total + least(200, 500 - b.total, length(r.text)), r.text from r join b on r.conv_id = b.conv_id and r.n = b.n + 1)
select conv_id, turn, substr(text, 1, used) as text from b where used > 0""")
def budgeted_text(t: Tables) -> DataFrame:
    """Turns cut to 200 characters each and 500 a conversation: what is used, not what is there, counts against the budget."""
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<turn:bigint,text:string>>").alias("out"))

    def step(s, x):
        room = F.least(F.lit(200), 500 - s["used"], F.length(x["text"]))
        cut = F.struct(x["turn"].alias("turn"), F.substring(x["text"], F.lit(1), room).alias("text"))
        return F.struct((s["used"] + room).cast("int").alias("used"), F.when(room > 0, F.concat(s["out"], F.array(cut))).otherwise(s["out"]).alias("out"))

    kept = turns.select("conv_id", F.explode(F.aggregate("turns", empty, step, lambda s: s["out"])).alias("x"))
    return kept.select("conv_id", "x.turn", "x.text")


@query(r"""select page_id, regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|head)\b.*?</(?:script|style|head)>', '', 'g'), '(?i)</?(?:p|div|br|li|ul|h[1-6]|tr|article|nav|footer)\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t]*\n\s*', chr(10), 'g'), '\A\s+|\s+\z', '', 'g') as text from pages""")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.page_text(F.col("html")).alias("text"))


@query(r"select page_id, case when host <> '' then 'https://' || regexp_replace(lower(host), ':443$', '') || coalesce(nullif(path, ''), '/') end as url from (select page_id, regexp_extract(url, '^(?i:https)://([^/?#@\s]+)([^?#\s]*)', 1) as host, regexp_extract(url, '^(?i:https)://([^/?#@\s]+)([^?#\s]*)', 2) as path from pages)")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("select event_id, key || chr(10) || (props->>key) as leaf from (select event_id, props, unnest(json_keys(props)) as key from events)")
def json_leaf_text(t: Tables) -> DataFrame:
    leaves = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return leaves.select("event_id", F.concat("k", F.lit("\n"), "v").alias("leaf"))


# --- corpora


@query("select min(doc_id) as doc_id, sha256(text) as hash, count(*) as copies from documents group by sha256(text)")
def exact_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(C.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("with a as (select *, row_number() over (partition by url order by page_id) as r from pages), b as (select *, row_number() over (partition by sha256(html) order by page_id) as r2 from a where r = 1) select page_id, url from b where r2 = 1")
def two_stage_dedup(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", "url", C.content_hash(F.col("html")).alias("hash"))
    return C.two_stage_dedup(rows, "url", "hash", "page_id").select("page_id", "url")


@query("select doc_id from documents where sha256(text) not in (select sha256(text) from documents where source = 'src0')")
def exclude_known_hashes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", C.content_hash(F.col("text")).alias("hash"))
    return C.exclude_known(rows, rows.where("source = 'src0'").select("hash").distinct(), "hash").select("doc_id")


@query("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) as r from (select *, row_number() over (partition by text order by doc_id) as c from documents) where c = 1) where r <= 10 + length(source)")
def source_quota(t: Tables) -> DataFrame:
    """The first rows of each source that no earlier row repeats, as many as the source's limit."""
    fresh = C.keep_first(t.documents.withColumn("hash", C.content_hash(F.col("text"))), ["hash"], ["doc_id"])
    return C.own_quota(fresh, "source", "doc_id", 10 + F.length("source")).select("doc_id", "source")


@query("""with c as (select source, count(*) as n from documents group by source), s as (select source, n, n * 0.3::double as share from c),
b as (select *, least(greatest(floor(share), (n > 1)::int), n - 1) as base, round(sum(n) over () * 0.3::double) as want from s),
f as (select *, row_number() over (order by base - share, source) as r, want - sum(base) over () as left_over from b),
k as (select source, base + (r <= left_over)::int as held from f)
select doc_id, source, case when r <= held then 'holdout' else 'train' end as split from (select doc_id, source, row_number() over (partition by source order by sha256(doc_id::varchar), doc_id) as r from documents) join k using (source)""")
def stratified_split(t: Tables) -> DataFrame:
    """Exact quotas by stratum; the SQL holds where no stratum's bound is met twice."""
    return C.stratified_split(t.documents.select("doc_id", "source"), "source", "doc_id", 0.3)


@query("with c as (select lang, count(*) as n from documents group by lang), s as (select lang, n, 100.0 * n / sum(n) over () as share from c), f as (select *, row_number() over (order by share - floor(share) desc, lang) as r, (100 - sum(floor(share)) over ())::int as left_over from s), k as (select lang, floor(share)::int + (r <= left_over)::int as take from f) select doc_id, d.lang from (select doc_id, lang, row_number() over (partition by lang order by sha256(doc_id::varchar), doc_id) as r from documents) d join k using (lang) where r <= take")
def stratified_sample(t: Tables) -> DataFrame:
    return C.stratified_sample(t.documents.select("doc_id", "lang"), "lang", "doc_id", 100)


@query("select doc_id, sha256(doc_id::varchar) as h from documents order by h, doc_id limit 50")
def hash_order_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.hash_order(F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(50)


@query("select 'd' || doc_id as id, 'documents' as part, sha256(text) as hash from documents union all select 'b' || item_id, 'benchmark', sha256(text) from benchmark")
def combined_corpus(t: Tables) -> DataFrame:
    part = lambda df, key, letter, name: df.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.lit(name).alias("part"), C.content_hash(F.col("text")).alias("hash"))
    return part(t.documents, "doc_id", "d", "documents").unionByName(part(t.benchmark, "item_id", "b", "benchmark"))


@query("select sha256(text) as hash from documents where doc_id % 2 = 0 intersect select sha256(text) from documents where doc_id % 2 = 1")
def split_overlap(t: Tables) -> DataFrame:
    hashes = t.documents.select("doc_id", C.content_hash(F.col("text")).alias("hash"))
    return hashes.where("doc_id % 2 = 0").select("hash").intersect(hashes.where("doc_id % 2 = 1").select("hash"))


@query("with m as (select sha256(text) as hash from documents where source <> 'src1'), p as (select sha256(text) as hash from documents where source <> 'src2') select hash, 'left' as side from (select hash from m except all select hash from p) union all select hash, 'right' from (select hash from p except all select hash from m)")
def manifest_diff(t: Tables) -> DataFrame:
    from corvia.operators.metrics import difference

    hashes = t.documents.select("source", C.content_hash(F.col("text")).alias("hash"))
    return difference(hashes.where("source <> 'src1'").select("hash"), hashes.where("source <> 'src2'").select("hash"))


_PARTS = " || '-' || ".join(f"sum(('0x' || substr(md5(doc_id || ':' || text), {i}, 8))::bigint)::varchar" for i in (1, 9, 17, 25))


@query(f"select count(*) as n, {_PARTS} as digest from documents")
def dataset_digest(t: Tables) -> DataFrame:
    return C.digest(t.documents, F.concat_ws(":", F.col("doc_id").cast("string"), "text"))


@query("select source, batch, array_to_string(list_sort(list(doc_id)), ',') as ids from (select source, doc_id, ((row_number() over (partition by source order by doc_id) - 1) // 8)::int as batch from documents) group by source, batch")
def batch_tasks(t: Tables) -> DataFrame:
    return C.batches(t.documents, "source", "doc_id", 8).withColumn("ids", F.array_join("ids", ","))


CLASSES = {"noise": ["***", "&&&", "%%%"], "shout": ["!!"], "table": [" | "], "legal": ["license", "licence", "rights"]}
_COUNT = {k: " + ".join(f"((length(t) - length(replace(t, {q(w)}, ''))) // {len(w)})" for w in v) for k, v in CLASSES.items()}
SQL_CLASS = "case when greatest(" + ", ".join(_COUNT.values()) + ") = 0 then 'prose' " + " ".join(f"when {c} = greatest({', '.join(_COUNT.values())}) then {q(k)}" for k, c in _COUNT.items()) + " end"


@query(f"select doc_id, {SQL_CLASS} as class from (select doc_id, lower(text) as t from documents)")
def keyword_class(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.keyword_class(F.col("text"), CLASSES, "prose").alias("class"))


#: The classes after a revision of their keywords.
REVISED_CLASSES = CLASSES | {"noise": ["***", "###"], "list": ["1.", "2."], "legal": ["license", "all rights"]}


def sql_class(classes: dict[str, list[str]]) -> str:
    counts = {k: " + ".join(f"((length(t) - length(replace(t, {q(w)}, ''))) // {len(w)})" for w in v) for k, v in classes.items()}
    most = f"greatest({', '.join(counts.values())})"
    return f"case when {most} = 0 then 'prose' " + " ".join(f"when {c} = {most} then {q(k)}" for k, c in counts.items()) + " end"


@query(f"with c as (select {sql_class(CLASSES)} as old, {sql_class(REVISED_CLASSES)} as new from (select lower(text) as t from documents)) select old, new, count(*) as n from c where old <> new group by old, new")
def reclassified_counts(t: Tables) -> DataFrame:
    """How many whole texts a revision of the keywords moves from one class to another."""
    both = t.documents.select(X.keyword_class(F.col("text"), CLASSES, "prose").alias("old"), X.keyword_class(F.col("text"), REVISED_CLASSES, "prose").alias("new"))
    return both.where("old <> new").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) as n, count(distinct sha256(text)) as n_unique, count(*) filter (length(text) <> n_chars) as wrong_length, count(*) filter (source is null) as no_source from documents group by lang")
def corpus_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(C.content_hash(F.col("text"))).alias("n_unique"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_length"), F.count_if(F.col("source").isNull()).alias("no_source"))


@query("select source, count(*) as attempted, count(l.doc_id) as covered, count(*) filter (l.quality = 1) as good from documents d left join labels l using (doc_id) group by source")
def run_coverage(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("attempted"), F.count("quality").alias("covered"), F.count_if(F.col("quality") == 1).alias("good"))


# --- constraints


@query("select doc_id, recorded, sha256(text) as found from (select doc_id, text, sha256(lower(text)) as recorded from documents) where recorded <> sha256(text)")
def hash_integrity(t: Tables) -> DataFrame:
    """Rows whose recorded hash (here that of the text in lower case) is not that of the text."""
    rows = t.documents.select("doc_id", F.sha2(F.lower("text"), 256).alias("recorded"), F.sha2("text", 256).alias("found"))
    return rows.where("recorded <> found")


@query("with r as (select conv_id, turn from conversations union all select conv_id, turn from conversations where role = 'assistant') select conv_id, turn, count(*) as n from r group by conv_id, turn having count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    """Keys that two logs merged into one have twice."""
    keys = t.conversations.select("conv_id", "turn", "role")
    return keys.unionByName(keys.where("role = 'assistant'")).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select 'orders' as tab, o_orderkey as key from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0) union all select 'labels', doc_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def orphan_keys(t: Tables) -> DataFrame:
    """Rows whose key a part of the other table lacks."""
    orders = t.orders.join(t.customer.where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("orders").alias("tab"), F.col("o_orderkey").alias("key"))
    return orders.unionByName(t.labels.join(t.documents.where("lang = 'en'"), "doc_id", "left_anti").select(F.lit("labels").alias("tab"), F.col("doc_id").alias("key")))
