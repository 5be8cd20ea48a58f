"""The reading tables as views over the driver's tables, and the same views as DuckDB SQL.

Every view is a deterministic projection of ``events``, ``documents`` and ``pages``; NOW is fixed.  A view is
a lazy DataFrame, so a query reads only the columns it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.texts import words
from quire.functions.urls import canonical, canonical_sql, host

NOW = "2024-02-01 00:00:00"
N_FEEDS = 8


def now() -> F.Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def days_ago(n: int) -> F.Column:
    return F.expr(f"timestamp_ntz'{NOW}' - interval '{n}' day")


def minutes_after(start: str, minutes: str) -> F.Column:
    return F.expr(f"timestamp_ntz'{start}' + make_dt_interval(0, 0, cast({minutes} as int), 0)")


class Views:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_docs(self) -> F.Column:
        return self.raw("documents").agg(F.count("*")).scalar()

    @cached_property
    def n_users(self) -> F.Column:
        return self.raw("events").agg(F.count_distinct("user_id")).scalar()

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("events").select("user_id").distinct()

    @cached_property
    def entries(self) -> DataFrame:
        """Posts: one a document."""
        created = minutes_after("2023-12-01 00:00:00", "(doc_id * 7919) % 89280")
        return self.raw("documents").select(
            F.col("doc_id").alias("entry_id"),
            (F.expr("try_cast(substring(source, 4) as bigint)") % N_FEEDS).alias("feed_id"),
            F.substring_index("text", ".", 1).alias("title"),
            F.col("text").alias("content"),
            "lang",
            words(F.col("text")).alias("words"),
            created.alias("created_at"),
            F.when(F.col("doc_id") % 11 != 0, created).alias("published_at"),
            created.alias("entry_date"),
        )

    @cached_property
    def feeds(self) -> DataFrame:
        """Feeds, with the state of their last poll; nobody follows the last one."""
        return self.spark.range(N_FEEDS + 1).select(
            F.col("id").alias("feed_id"),
            F.concat(F.lit("https://feed"), F.col("id").cast("string"), F.lit(".example.com/rss")).alias("url"),
            F.when(F.col("id") % 3 != 0, F.concat(F.lit("Feed "), F.col("id").cast("string"))).alias("title"),
            F.when(F.col("id") % 5 != 0, F.expr(f"timestamp_ntz'{NOW}' + make_dt_interval(0, 0, cast((id * 37) % 120 - 60 as int), 0)")).alias("next_fetch_at"),
            (F.col("id") % 4).alias("error_count"),
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        """Users and the feeds they follow."""
        pairs = self.users.withColumn("feed_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(N_FEEDS - 1).cast("long"))))
        return pairs.where((F.col("user_id") + F.col("feed_id")) % 3 != 0).select(
            "user_id",
            "feed_id",
            F.when(F.col("feed_id") % 4 != 0, F.concat(F.lit("f"), (F.col("feed_id") % 4).cast("string"))).alias("folder"),
            F.when((F.col("user_id") + F.col("feed_id")) % 7 == 0, F.lit("Renamed")).alias("title_override"),
            minutes_after("2024-01-01 00:00:00", "(user_id * 37 + feed_id * 101) % 30000").alias("followed_at"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        """Events on posts: (user, entry, kind, stamp, event_id)."""
        return self.raw("events").select(
            "user_id",
            ((F.col("user_id") * 31 + F.col("event_id") % 20) % self.n_docs).alias("entry_id"),
            "event_type",
            F.col("ts").alias("stamp"),
            "event_id",
            "value",
        )

    @cached_property
    def entry_state(self) -> DataFrame:
        """What users did with posts; no row means unread."""
        at = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("stamp"))
        return (
            self.actions.where(F.col("event_type") != "purchase")
            .groupBy("user_id", "entry_id")
            .agg(
                F.min(at("view")).alias("opened_at"),
                F.min(at("view", "signup", "error")).alias("read_at"),
                F.max(at("error")).alias("dismissed_at"),
                F.max(at("click")).alias("cited_at"),
            )
        )

    @cached_property
    def history(self) -> DataFrame:
        """Outcomes of posts that are gone: from purchases, opened when the event's number is even, else dismissed."""
        even = F.col("event_id") % 2 == 0
        return (
            self.actions.where(F.col("event_type") == "purchase")
            .groupBy("user_id", "entry_id")
            .agg(F.min(F.when(even, F.col("stamp"))).alias("opened_at"), F.max(F.when(~even, F.col("stamp"))).alias("dismissed_at"))
            .withColumn("feed_id", F.col("entry_id") % N_FEEDS)
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """One a user and post, from the last event of the pair."""
        return (
            self.actions.where(F.col("event_type") != "purchase")
            .groupBy("user_id", "entry_id")
            .agg(F.max("event_id").alias("e"))
            .select(
                "user_id",
                "entry_id",
                ((F.col("e") * 7919) % 1000 / F.lit(1000.0)).alias("p_open"),
                F.when(F.col("e") % 9 != 0, (F.col("e") * 104729) % 1000 / F.lit(1000.0)).alias("p_keep"),
                F.when(F.col("e") % 10 == 0, F.lit("unreadable")).alias("error"),
                (F.col("e") % 4).alias("attempts"),
                F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(e % 300 as int), 0)").alias("updated_at"),
            )
        )

    @cached_property
    def link_predictions(self) -> DataFrame:
        """Predictions of a third of the saved pages, some of them failed."""
        k = F.col("link_id")
        late = F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast(link_id % 300 as int), 0)")
        return self.links.where("link_id % 3 = 1").select("user_id", "link_id", F.when(k % 2 == 0, F.lit("unreadable")).alias("error"), (k % 4).alias("attempts"), late.alias("updated_at"), (k * 7919 % 1000 / F.lit(1000.0)).alias("p_open"), F.when(k % 5 != 0, k * 104729 % 1000 / F.lit(1000.0)).alias("p_keep"))

    @cached_property
    def link_categories(self) -> DataFrame:
        """The saved pages that have a category."""
        return self.links.where("link_id % 4 = 2").select("user_id", "link_id", F.concat(F.lit("c"), (F.col("link_id") % 5).cast("string")).alias("slug"))

    @cached_property
    def link_places(self) -> DataFrame:
        """Where users stopped in saved pages that they opened."""
        k = F.col("link_id")
        return self.links.where("opened_at is not null and link_id % 8 <> 0").select("user_id", "link_id", (F.col("opened_at") + F.expr("interval '7' minute")).alias("updated_at"), (k % 10 / F.lit(10.0)).alias("progress"))

    @cached_property
    def links(self) -> DataFrame:
        """Saved pages."""
        url = F.col("url")
        saved = minutes_after("2024-01-01 00:00:00", "(page_id * 7919) % 44640")
        k = F.col("page_id")
        return self.raw("pages").select(
            k.alias("link_id"),
            (k % self.n_users).alias("user_id"),
            url,
            canonical(url).alias("canonical_url"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            host(canonical(url)).alias("site_name"),
            F.when(k % 3 == 0, F.lit("archived")).otherwise(F.lit("queued")).alias("status"),
            (k % 4 == 1).alias("is_reference"),
            F.when(k % 6 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("note"),
            F.when(k % 2 == 1, F.concat(F.lit("Author "), (k % 13).cast("string"))).alias("author"),
            F.when(k % 3 != 2, F.concat(F.lit('=About "'), (k % 17).cast("string"), F.lit('"'))).alias("description"),
            F.when(k % 5 == 0, F.lit("feed")).otherwise(F.lit("web")).alias("source"),
            F.when(k % 5 == 0, (k * 3) % self.n_docs).alias("source_entry_id"),
            saved.alias("saved_at"),
            F.when(k % 4 == 1, saved + F.expr("interval '1' hour")).alias("starred_at"),
            F.when(k % 3 == 0, saved + F.expr("interval '2' hour")).alias("read_at"),
            F.when(k % 2 == 0, saved + F.expr("interval '30' minute")).alias("opened_at"),
            (k % 5).alias("cite_count"),
            F.when(k % 5 != 0, saved + F.expr("interval '3' hour")).alias("cited_at"),
            (saved + F.expr("interval '3' hour")).alias("updated_at"),
        )

    @cached_property
    def link_tags(self) -> DataFrame:
        """(link, tag) pairs: by number, and the language in the path."""
        k = F.col("page_id")
        lang = F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1)
        names = F.array(F.concat(F.lit("t"), (k % 7).cast("string")), F.concat(F.lit("u"), (k % 60).cast("string")), lang)
        return self.raw("pages").select(k.alias("link_id"), F.explode(F.array_distinct(F.filter(names, lambda t: t != ""))).alias("tag"))

    @cached_property
    def archives(self) -> DataFrame:
        """Readable copies of the saved pages and their fetch state."""
        k = F.col("page_id")
        status = F.element_at(F.array(*map(F.lit, ("pending", "fetching", "ready", "failed", "ready"))), (k % 5 + 1).cast("int"))
        return self.raw("pages").select(
            k.alias("link_id"),
            status.alias("status"),
            (k % 4).alias("attempts"),
            F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(0, 0, cast((page_id * 13) % 400 as int), 0)").alias("updated_at"),
            F.when(k % 3 == 0, F.expr(f"timestamp_ntz'{NOW}' + make_dt_interval(cast(page_id % 29 - 14 as int), 0, 0, 0)")).alias("keep_until"),
            F.when(k % 5 == 2, (k * 37) % 2500).alias("words"),
        )

    @cached_property
    def places(self) -> DataFrame:
        """Where users stopped reading: the last sign-up of each user and post."""
        return (
            self.actions.where("event_type = 'signup'")
            .groupBy("user_id", "entry_id")
            .agg(F.max_by(F.struct("stamp", "value"), F.col("event_id")).alias("s"))
            .select("user_id", "entry_id", F.col("s.stamp").alias("updated_at"), F.least(F.lit(1.0), F.col("s.value") / 200).alias("progress"), F.floor("s.value").alias("block"))
        )

    @cached_property
    def highlights(self) -> DataFrame:
        """Marked passages: the high-valued clicks."""
        return self.actions.where("event_type = 'click' and value > 40").select(
            F.col("event_id").alias("highlight_id"),
            "user_id",
            "entry_id",
            F.floor("value").alias("block"),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("hn "), F.col("event_id").cast("string"))).alias("note"),
            F.col("stamp").alias("created_at"),
        )

    @cached_property
    def item_categories(self) -> DataFrame:
        """Placements of posts: a first category, perhaps a second."""
        e = F.col("e")
        return (
            self.actions.where("event_type in ('view', 'click')")
            .groupBy("user_id", "entry_id")
            .agg(F.max("event_id").alias("e"))
            .select(
                "user_id",
                "entry_id",
                F.concat(F.lit("c"), (e % 5).cast("string")).alias("primary_slug"),
                F.when(e % 3 == 0, F.concat(F.lit("c"), ((e + 1) % 5).cast("string"))).alias("secondary_slug"),
                (e % 13 == 0).alias("corrected"),
            )
        )


def _ago(expr: str) -> str:
    return f"(timestamp '{NOW}' - to_minutes(cast({expr} as bigint)))"


CTES = {
    "k_docs": (" select count(*) as n from documents", ()),
    "k_users": ("select count(distinct user_id) as n from events", ()),
    "users": ("select distinct user_id from events", ()),
    "entries": (
        f"""select doc_id as entry_id, try_cast(substr(source, 4) as bigint) % {N_FEEDS} as feed_id, split_part(text, '.', 1) as title,
        text as content, lang, len(regexp_extract_all(text, '\\S+')) as words,
        timestamp '2023-12-01' + to_minutes((doc_id * 7919) % 89280) as created_at,
        case when doc_id % 11 <> 0 then timestamp '2023-12-01' + to_minutes((doc_id * 7919) % 89280) end as published_at,
        timestamp '2023-12-01' + to_minutes((doc_id * 7919) % 89280) as entry_date from documents""",
        (),
    ),
    "feeds": (
        f"""select range as feed_id, 'https://feed' || range || '.example.com/rss' as url, case when range % 3 <> 0 then 'Feed ' || range end as title,
        case when range % 5 <> 0 then timestamp '{NOW}' + to_minutes((range * 37) % 120 - 60) end as next_fetch_at, range % 4 as error_count from range({N_FEEDS + 1})""",
        (),
    ),
    "subs": (
        f"""select user_id, range as feed_id, case when range % 4 <> 0 then 'f' || (range % 4) end as folder,
        case when (user_id + range) % 7 = 0 then 'Renamed' end as title_override,
        timestamp '2024-01-01' + to_minutes((user_id * 37 + range * 101) % 30000) as followed_at from users, range({N_FEEDS}) where (user_id + range) % 3 <> 0""",
        ("users",),
    ),
    "actions": ("select user_id, (user_id * 31 + event_id % 20) % n as entry_id, event_type, ts as stamp, event_id, value from events, k_docs", ("k_docs",)),
    "state": (
        """select user_id, entry_id, min(case when event_type = 'view' then stamp end) as opened_at,
        min(case when event_type in ('view', 'signup', 'error') then stamp end) as read_at, max(case when event_type = 'error' then stamp end) as dismissed_at,
        max(case when event_type = 'click' then stamp end) as cited_at from actions where event_type <> 'purchase' group by all""",
        ("actions",),
    ),
    "history": (
        f"""select user_id, entry_id, min(case when event_id % 2 = 0 then stamp end) as opened_at, max(case when event_id % 2 <> 0 then stamp end) as dismissed_at,
        entry_id % {N_FEEDS} as feed_id from actions where event_type = 'purchase' group by user_id, entry_id""",
        ("actions",),
    ),
    "predictions": (
        f"""select user_id, entry_id, ((e * 7919) % 1000) / 1000.0e0 as p_open, case when e % 9 <> 0 then ((e * 104729) % 1000) / 1000.0e0 end as p_keep,
        case when e % 10 = 0 then 'unreadable' end as error, e % 4 as attempts, {_ago('e % 300')} as updated_at
        from (select user_id, entry_id, max(event_id) as e from actions where event_type <> 'purchase' group by all)""",
        ("actions",),
    ),
    "links": (
        f"""select page_id as link_id, page_id % n as user_id, url, {canonical_sql('url')} as canonical_url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
        regexp_extract({canonical_sql('url')}, '^https://([^/]+)/', 1) as site_name, case when page_id % 3 = 0 then 'archived' else 'queued' end as status,
        page_id % 4 = 1 as is_reference, case when page_id % 6 = 0 then 'note ' || page_id end as note,
        case when page_id % 2 = 1 then 'Author ' || page_id % 13 end as author, case when page_id % 3 <> 2 then '=About "' || page_id % 17 || '"' end as description,
        case when page_id % 5 = 0 then 'feed' else 'web' end as source,
        case when page_id % 5 = 0 then (page_id * 3) % d end as source_entry_id, saved_at,
        case when page_id % 4 = 1 then saved_at + interval 1 hour end as starred_at, case when page_id % 3 = 0 then saved_at + interval 2 hour end as read_at,
        case when page_id % 2 = 0 then saved_at + interval 30 minute end as opened_at, page_id % 5 as cite_count,
        case when page_id % 5 <> 0 then saved_at + interval 3 hour end as cited_at, saved_at + interval 3 hour as updated_at
        from (select *, timestamp '2024-01-01' + to_minutes((page_id * 7919) % 44640) as saved_at from pages), k_users, (select n as d from k_docs)""",
        ("k_users", "k_docs"),
    ),
    "link_predictions": (
        f"""select user_id, link_id, case when link_id % 2 = 0 then 'unreadable' end as error, link_id % 4 as attempts, {_ago('link_id % 300')} as updated_at,
        ((link_id * 7919) % 1000) / 1000.0e0 as p_open, case when link_id % 5 <> 0 then ((link_id * 104729) % 1000) / 1000.0e0 end as p_keep from links where link_id % 3 = 1""",
        ("links",),
    ),
    "link_categories": ("select user_id, link_id, 'c' || link_id % 5 as slug from links where link_id % 4 = 2", ("links",)),
    "link_places": ("select user_id, link_id, opened_at + interval 7 minute as updated_at, (link_id % 10) / 10.0e0 as progress from links where opened_at is not null and link_id % 8 <> 0", ("links",)),
    "link_tags": (
        """select page_id as link_id, unnest(list_distinct(list_filter(['t' || (page_id % 7), 'u' || (page_id % 60), regexp_extract(url, '://[^/]+/([a-z]{2})/', 1)],
        lambda t: t <> ''))) as tag from pages""",
        (),
    ),
    "archives": (
        f"""select page_id as link_id, ['pending', 'fetching', 'ready', 'failed', 'ready'][page_id % 5 + 1] as status, page_id % 4 as attempts,
        {_ago('(page_id * 13) % 400')} as updated_at, case when page_id % 3 = 0 then timestamp '{NOW}' + to_days(cast(page_id % 29 - 14 as int)) end as keep_until,
        case when page_id % 5 = 2 then (page_id * 37) % 2500 end as words from pages""",
        (),
    ),
    "places": (
        """select user_id, entry_id, arg_max(stamp, event_id) as updated_at, least(1.0e0, arg_max(value, event_id) / 200) as progress,
        cast(floor(arg_max(value, event_id)) as bigint) as block from actions where event_type = 'signup' group by user_id, entry_id""",
        ("actions",),
    ),
    "highlights": (
        """select event_id as highlight_id, user_id, entry_id, cast(floor(value) as bigint) as block, case when event_id % 3 = 0 then 'hn ' || event_id end as note,
        stamp as created_at from actions where event_type = 'click' and value > 40""",
        ("actions",),
    ),
    "item_categories": (
        """select user_id, entry_id, 'c' || (e % 5) as primary_slug, case when e % 3 = 0 then 'c' || ((e + 1) % 5) end as secondary_slug, e % 13 = 0 as corrected
        from (select user_id, entry_id, max(event_id) as e from actions where event_type in ('view', 'click') group by all)""",
        ("actions",),
    ),
}


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: the named views and those they need, then ``body`` (which may go on with ``, more as (...)``)."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][1]:
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} as ({CTES[n][0]})" for n in order)
    return f"with {head}{body}" if body.lstrip().startswith(",") else f"with {head}\n{body}"
