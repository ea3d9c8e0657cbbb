"""Secret scans with multipart credential linking.

Base spans are matches of three patterns. The method adds weak candidates, which alone say little:
user or key identifiers, short or unlabelled secret-like strings (padded or not), secrets under a longer
label, and endpoints. An interval join
within a scope (a window of code points of one document) reports a weak candidate only where a part
of another role stands close by: an identifier beside a secret, an endpoint beside either. Parts that
overlap don't complete each other, and what stands in the path or query of a link is part of the link
and no candidate; a secret in its user part is one, and its endpoint completes it.

DataFrame functions only. Positions come from the pattern alone: split() gives the text between
matches, regexp_extract_all() the matches. Each match is a row with its length and the length of the
text before it, and running sums by document and kind give the ends, so work on a text is linear in
its length and its number of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, private, read_table

#: The three base patterns of the contract, their least lengths, and the order of kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Weak candidates: kind, role, pattern. Secrets with and without padding, and labels in which a secret's name is followed by more.
WEAK = (
    ("ident", "id", r"""(?i:user|username|login|client_?id|account)\x20?[:=]\x20?[A-Za-z0-9_.@-]{3,}"""),
    ("opaque", "secret", r"[A-Za-z0-9+/_-]{20,}={0,2}"),
    ("endpoint", "endpoint", r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9._~:@-]{3,}"),
    ("labelled", "secret", r"""(?i:secret|private|access|auth|session|signing|encryption)[A-Za-z0-9_-]*(?i:key|token)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
)
#: A link, and what of it stands before its host: the rest is the link's body, in which nothing but its endpoint is a candidate.
LINK, LINK_HEAD = r"[a-z][a-z0-9+]{1,9}://[^\x20\x09-\x0D]+", r"^[a-z][a-z0-9+]{1,9}://(?:[^\x20\x09-\x0D/@]*@)?"
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint", "labelled")
#: An opaque string is secret-like if it is padded base64, or if it mixes capitals, small letters and digits.
PADDED, MIXED = r"(^|[_-])[A-Za-z0-9+/]{32,}=", ("[a-z]", "[A-Z]", "[0-9]")
#: Code points between the nearer ends of two parts that belong together.
SCOPE = 256


_PART = "array<struct<kind:string,i:int,gap:int,size:int,ok:boolean>>"


def parts_of(text: Column, hint: Column, pattern: str, kind: str, keep=None, skip=None) -> Column:
    """One struct for each leftmost non-overlapping match: its number, the length of the text since the one before, its own, and whether keep(match) holds.
    skip(match) characters at its beginning don't count as its own.

    Only where hint says that there can be any: most texts are passed over by one search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("match"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"))
    as_part = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), (F.length(x["gap"]) + (skip(x["match"]) if skip else 0)).alias("gap"), (F.length(x["match"]) - (skip(x["match"]) if skip else 0)).alias("size"), (keep(x["match"]) if keep else F.lit(True)).alias("ok"))
    return F.when(hint, F.transform(pairs, as_part)).otherwise(F.array().cast(_PART))


def find_parts(text: Column) -> Column:
    """All base spans and weak candidates of a text."""
    value = lambda m: F.length(F.regexp_replace(m, ASSIGN_VALUE, "")) >= LEAST_ASSIGN
    base = [
        parts_of(text, F.regexp_like(text, F.lit(ASSIGN)), ASSIGN, "assign", value),
        parts_of(text, F.contains(text, F.lit("AKIA")), ACCESS, "access", lambda m: F.length(m) >= LEAST_ACCESS),
        parts_of(text, F.regexp_like(text, F.lit(HEX)), HEX, "hex"),
    ]
    base.append(parts_of(text, F.contains(text, F.lit("://")), LINK, "link", skip=lambda m: F.length(F.regexp_extract(m, LINK_HEAD, 0))))
    like = lambda m: F.regexp_like(m, F.lit(PADDED)) | F.regexp_like(m, F.lit(MIXED[0])) & F.regexp_like(m, F.lit(MIXED[1])) & F.regexp_like(m, F.lit(MIXED[2]))
    return F.concat(*base, *[parts_of(text, F.regexp_like(text, F.lit(p)), p, k, like if k == "opaque" else None) for k, _, p in WEAK])


def placed(parts: DataFrame) -> DataFrame:
    """(row, parts) -> (row, kind, start, end): running sums over the matches of a text, kind by kind. A document's spans are one task's, as its text is."""
    p = parts.where(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return p.withColumn("end", end).where("ok").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def is_weak(kind: Column) -> Column:
    return kind.isin([k for k, _, _ in WEAK])


def role(kind: Column) -> Column:
    out = F.when(kind == "access", "id").when(kind.isin("assign", "hex"), "secret")
    for k, r, _ in WEAK:
        out = out.when(kind == k, r)
    return out


def place(kind: Column) -> Column:
    """The place of a kind in KINDS."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind).cast("int")


def in_cells(spans: DataFrame, scope: int) -> DataFrame:
    """spans with a row for each cell of `scope` code points that they touch."""
    cell = lambda c: F.floor(c / scope).cast("int")
    return spans.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))


def outside_links(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """spans (row, kind, start, end) less links, and less the weak ones other than endpoints that overlap a link's body."""
    bodies = in_cells(spans.where("kind = 'link'"), scope).select(F.col("row").alias("row2"), F.col("cell").alias("cell2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    spans = spans.where("kind <> 'link'")
    inner = is_weak(F.col("kind")) & (F.col("kind") != "endpoint")
    touched = in_cells(spans.where(inner), scope)
    hit = touched.join(bodies, (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & (F.col("start") < F.col("e2")) & (F.col("s2") < F.col("end")), "left_semi")
    hit = hit.select(F.col("row").alias("row2"), F.col("kind").alias("kind2"), F.col("start").alias("s2")).distinct()
    return spans.join(hit, (F.col("row") == F.col("row2")) & (F.col("kind") == F.col("kind2")) & (F.col("start") == F.col("s2")), "left_anti")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak ones of `spans` (row, kind, start, end) that have a part of another role within `scope`.

    An interval join: a part stands in every cell of `scope` code points that it covers, a candidate
    looks into its own cells and one on each side, and the join is on (row, cell). A cell holds only
    as many parts as fit in it, so neither a long document nor a hot source makes a large group, and
    the semi join makes no pairs.
    """
    p = spans.withColumn("role", role(F.col("kind")))
    cell = lambda c: F.floor(c / scope).cast("int")
    there = p.select(F.col("row").alias("row2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.col("kind").alias("k2"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell2"))
    here = p.where(is_weak(F.col("kind"))).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope))))
    near = (F.col("role") != F.col("r2")) & (F.col("start") - F.col("e2") <= scope) & (F.col("s2") - F.col("end") <= scope)
    # What of an opaque string is left in a link stands in its user part, which its endpoint covers.
    in_user_part = F.array_sort(F.array("kind", "k2")) == F.array(F.lit("endpoint"), F.lit("opaque"))
    near &= (F.col("start") >= F.col("e2")) | (F.col("s2") >= F.col("end")) | in_user_part
    return here.join(there, (F.col("row") == F.col("row2")) & (F.col("cell") == F.col("cell2")) & near, "left_semi").select("row", "kind", "start", "end").distinct()


_FOUND = "array<struct<start:int,place:int,kind:string,end:int>>"


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row, base and found, the base and all reported spans.

    Both are array<struct<start, place, kind, end>>, sorted by start and then by kind as in KINDS;
    positions are code points, end exclusive. Base spans are always reported, weak candidates only
    beside a complementary part. row names a column of docs that tells its rows apart (the default
    is made here). Null and empty texts have no spans, texts of any length are scanned whole, repeated
    rows are scanned each, a null doc_id stays null, an empty table gives an empty table, and other
    columns of docs are ignored.
    """
    t = narrow(docs, doc_id=doc_id, text=F.coalesce(F.col(text), F.lit("")), row=F.col(row) if row else F.monotonically_increasing_id())
    t = cut(t.select("doc_id", "row", find_parts(F.col("text")).alias("parts")))  # every text is read once; from here on there are only spans
    spans = cut(outside_links(cut(placed(t)), scope))
    found = spans.where(~is_weak(F.col("kind"))).unionByName(linked(spans, scope)).select("row", F.struct("start", place(F.col("kind")).alias("place"), "kind", "end").alias("x"))
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("found"))
    t = t.select("doc_id", "row").join(by_row, "row", "left")
    t = t.withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))
    return t.select("doc_id", "row", F.filter("found", lambda x: ~is_weak(x["kind"])).alias("base"), "found")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


#: Code points to a block of a text that is taken apart.
BLOCK = 1024


def stretch(blocks: Column, start: Column, end: Column) -> Column:
    """The code points start..end of a text given in blocks: only the blocks that hold them are read."""
    first = F.floor(start / BLOCK).cast("int")
    count = F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0))

    def piece(b: Column, j: Column) -> Column:
        at = (first + j) * BLOCK
        low = F.greatest(start - at, F.lit(0))
        return F.substring(b, low + 1, F.greatest(F.least(end - at, F.lit(BLOCK)) - low, F.lit(0)))

    return F.array_join(F.transform(F.slice(blocks, first + 1, count), piece), "")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by a mark; the columns of docs stay as they are.

    Overlapping spans are joined first: one mark stands for them. Null texts, empty ones and texts
    without spans are unchanged; repeated rows are replaced each; work is linear in a text's length.
    """
    names = docs.columns
    key, spans_name, found_row = (private(names, k) for k in ("row", "spans", "found"))
    t = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    x = scan(t, doc_id=key, text=text, row=key).where(F.size("found") > 0).select("row", F.explode("found").alias("x")).select("row", "x.start", "x.end")
    order = W.partitionBy("row").orderBy("start", "end")
    x = x.withColumn("reach", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("n", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order))
    x = x.groupBy("row", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = x.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans_name)).withColumnRenamed("row", found_row)
    t = t.join(found, F.col(key) == F.col(found_row), "left")
    source, spans = F.col(text), F.col(spans_name)
    none = F.array(F.lit(0))
    gaps = F.arrays_zip(F.concat(none, F.transform(spans, lambda s: s["end"])).alias("a"), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(source))).alias("b"))
    blocks = F.regexp_extract_all(source, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # The blocks are bound once: the lambda reads them for every gap.
    clean = F.transform(F.array(F.struct(blocks.alias("blocks"), gaps.alias("gaps"))), lambda s: F.array_join(F.transform(s["gaps"], lambda g: stretch(s["blocks"], g["a"], g["b"])), mark))[0]
    return t.withColumn(text, F.when(spans.isNull(), source).otherwise(clean)).select(*names)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return t.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql_spans(kind: str, pattern: str, keep: str, skip: str = "0") -> str:
    """DuckDB: the spans of one kind; keep is a condition on found[i]."""
    p = pattern.replace("'", "''")
    return f"""select row, '{kind}' as kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::bigint + {skip} as start, length(found[i]) - {skip} as size, found[i] as m
    from (select row, found, string_split_regex(text, '{p}') as gaps, unnest(range(1, len(found) + 1)) as i from (select row, text, regexp_extract_all(text, '{p}') as found from d) where len(found) > 0) where {keep}"""


def op5_sql() -> str:
    value = ASSIGN_VALUE.replace("'", "''")
    keeps = {"assign": f"length(regexp_replace(found[i], '{value}', '')) >= {LEAST_ASSIGN}", "access": f"length(found[i]) >= {LEAST_ACCESS}"}
    keeps["opaque"] = f"(regexp_matches(found[i], '{PADDED}') or " + " and ".join(f"regexp_matches(found[i], '{c}')" for c in MIXED) + ")"
    parts = [_sql_spans(k, p, keeps.get(k, "true")) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), *[(k, p) for k, _, p in WEAK])]
    head = LINK_HEAD.replace("'", "''")
    link = _sql_spans("link", LINK, "true", f"length(regexp_extract(found[i], '{head}'))")
    places = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    roles = "when 'access' then 'id' when 'assign' then 'secret' when 'hex' then 'secret' " + " ".join(f"when '{k}' then '{r}'" for k, r, _ in WEAK)
    return f"""with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
l as ({link}),
p as (select row, kind, start, start + size as stop, case kind {places} end as place, case kind {roles} end as role, kind in ('assign', 'access', 'hex') as base from ({" union all ".join(parts)}) s
  where kind not in ('ident', 'opaque', 'labelled') or not exists (select 1 from l where l.row = s.row and s.start < l.start + l.size and l.start < s.start + s.size)),
f as (select * from p where base or exists (select 1 from p q where q.row = p.row and q.role <> p.role and p.start - q.stop <= {SCOPE} and q.start - p.stop <= {SCOPE}
  and (p.start >= q.stop or q.start >= p.stop or (p.kind, q.kind) in (('opaque', 'endpoint'), ('endpoint', 'opaque'))))),
g as (select row, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) filter (base) as base, string_agg(kind || ':' || start || ':' || stop, ',' order by start, place) as spans from f group by row)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on d.row = g.row"""
