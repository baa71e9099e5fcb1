"""Synthetic supporters and channel rows as pure functions of row numbers.

Every generator takes a frame with a bigint column ``n`` (for instance
``spark.range(1, rows + 1)``) and draws all values from hashes of ``n``. A supporter's persona is
recomputed from the supporter number wherever it is needed, so no generator needs a join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from audience_lens.config import EVENT_PAGES, TIERS, EngineConfig
from audience_lens.functions.cleaning import clock, moment
from audience_lens.functions.hashing import (
    drawn, hash60, pick, pick_index, pick_weighted, with_draws,
)
from audience_lens.sources.adapters import CAMPAIGNS, CATEGORIES

# Personas with their shares.
PERSONAS = [("ticket_browser", 0.14), ("cart_abandoner", 0.13), ("loyal_attendee", 0.12),
            ("big_spender", 0.10), ("lapsed", 0.14), ("intl_merch", 0.12), ("casual", 0.25)]
# Countries with their shares.
COUNTRIES = [("United Kingdom", 0.55), ("United States", 0.14), ("Nigeria", 0.06), ("India", 0.06),
             ("Germany", 0.04), ("Norway", 0.03), ("Japan", 0.03), ("Canada", 0.03),
             ("Australia", 0.03), ("United Arab Emirates", 0.03)]
CITIES = {
    "United Kingdom": ["Bath", "York", "Cardiff", "Dundee"],
    "United States": ["Portland", "Tucson", "Omaha"],
    "Nigeria": ["Jos", "Enugu"],
    "India": ["Pune", "Jaipur"],
    "Germany": ["Bremen", "Leipzig"],
    "Norway": ["Tromso", "Bodo"],
    "Japan": ["Kobe", "Sapporo"],
    "Canada": ["Halifax", "Regina"],
    "Australia": ["Perth", "Hobart"],
    "United Arab Emirates": ["Sharjah", "Ajman"],
}
# Age bands with their weights.
AGE_BANDS = [("18-24", 18), ("25-34", 28), ("35-44", 22), ("45-54", 15), ("55-64", 10), ("65+", 7)]
# Tiers by persona; other personas draw from the weighted list.
PERSONA_TIERS = {"loyal_attendee": ["None", "Free", "Silver"],
                 "big_spender": ["Gold", "Red Member", "Silver"],
                 "lapsed": ["None", "Free"],
                 "intl_merch": ["None", "Free", "Silver"]}
TIER_WEIGHTS = list(zip(TIERS, (30, 25, 20, 15, 10)))
# Event weights by persona, in the order of EVENT_PAGES; others are uniform.
EVENT_WEIGHTS = {"ticket_browser": (45, 8, 6, 5, 3, 6, 4, 3, 12, 8),
                 "cart_abandoner": (6, 30, 22, 18, 14, 3, 2, 2, 2, 1),
                 "loyal_attendee": (20, 8, 6, 4, 2, 22, 6, 6, 18, 8),
                 "intl_merch": (4, 30, 26, 16, 8, 4, 2, 3, 4, 3),
                 "lapsed": (8, 6, 6, 4, 4, 6, 4, 6, 30, 26)}
# Merchandise base prices and quantity weights.
BASE_PRICES = {"Home Shirt": 80, "Away Shirt": 80, "Third Kit": 75, "Training Wear": 55,
               "Accessories": 20, "Retro": 65, "Kids": 50}
QUANTITIES = [(1, 85), (2, 10), (3, 5)]
# Ticket types with weight and base price.
TICKETS = [("General Admission", 45, 55), ("Club Level", 20, 120), ("Family Enclosure", 15, 45),
           ("Hospitality", 12, 350), ("Away End", 8, 40)]
# Invented visitors, one for each match slot.
COMPETITIONS = ["Premier League"] * 9 + ["Champions League"] * 2 + ["Carabao Cup"]
OPPONENTS = [(f"Visitors {chr(ord('A') + i)}", c) for i, c in enumerate(COMPETITIONS)]
# Open rate by persona, then click and conversion rates.
OPEN_RATES = {"loyal_attendee": 0.62, "big_spender": 0.58, "ticket_browser": 0.5,
              "cart_abandoner": 0.48, "intl_merch": 0.45, "casual": 0.32, "lapsed": 0.12}
CLICK_RATE, CONVERT_RATE = 0.4, 0.22

FIRST_NAMES = ["Ada", "Ben", "Cleo", "Dara", "Eli", "Fay", "Gus", "Hana", "Ivo", "June", "Kit",
               "Lena", "Milo", "Nia", "Omar", "Pia", "Quin", "Rosa", "Seth", "Tara"]

# Dirty supporters and replayed orders that are injected.
DIRTY_CASING, DIRTY_TIER, DIRTY_AGE, REPLAYS = 20, 10, 10, 30

# Days of history, and days since the last activity of lapsed supporters.
HISTORY_DAYS, LAPSED_WEB_DAYS, LAPSED_MAIL_DAYS = 365, 60, 45


def supporter_id(n: Column) -> Column:
    """S plus the number, at least six digits, never cut."""
    digits = n.cast("string")
    return F.concat(F.lit("S"), F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), "0"))


def _with_persona(df: DataFrame, key: str, seed: int) -> DataFrame:
    return with_draws(df, key, seed, {"persona": 1}).withColumn(
        "_persona", pick_weighted(drawn("persona"), PERSONAS))


def _by_persona(values: dict[str, Column], who: Column, default: Column) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(who == name, value)
    return chain.otherwise(default)


def _moment(u: Column, start: dt.datetime, end: dt.datetime) -> Column:
    """Uniform second between two times."""
    seconds = F.floor(u * (int((end - start).total_seconds()) + 1)).cast("bigint")
    return moment(start) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def _channel(rows: DataFrame, tag: str, n_supporters: int, seed: int,
             draws: dict[str, int]) -> DataFrame:
    """Row number, its draws, the supporter number drawn for it and that supporter's persona."""
    frame = with_draws(rows.select("n"), "n", seed, draws | {f"{tag}.who": 1}).withColumn(
        "_who", pick_index(drawn(f"{tag}.who"), F.lit(n_supporters)) + 1)
    return _with_persona(frame, "_who", seed)


def gen_supporters(rows: DataFrame, cfg: EngineConfig, seed: int = 7,
                   with_persona: bool = False) -> DataFrame:
    draws = {"country": 1, "city": 1, "tier": 1, "name": 4, "misc": 3}
    people = _with_persona(with_draws(rows.select("n"), "n", seed, draws), "n", seed).withColumn(
        "country", pick_weighted(drawn("country"), COUNTRIES))
    u_tier = drawn("tier")
    tier = _by_persona({p: pick(u_tier, t) for p, t in PERSONA_TIERS.items()}, F.col("_persona"),
                       pick_weighted(u_tier, TIER_WEIGHTS))
    city = _by_persona({c: pick(drawn("city"), v) for c, v in CITIES.items()}, F.col("country"),
                       F.lit("Bath"))
    first = dt.date(2016, 1, 1)
    days = (cfg.ref_ts.date() - dt.timedelta(days=30) - first).days + 1
    out = people.withColumn("membership_tier", tier).select(
        supporter_id(F.col("n")).alias("supporter_id"),
        pick(drawn("name"), FIRST_NAMES).alias("first_name"),
        pick_weighted(drawn("name", 1), AGE_BANDS).alias("age_band"),
        "country", city.alias("city"), "membership_tier",
        F.concat(F.lit("Player "), (pick_index(drawn("name", 2), 11) + 1).cast("string"))
        .alias("favourite_player"),
        pick(drawn("name", 3), list(CATEGORIES)).alias("favourite_product_category"),
        F.date_add(F.lit(first), pick_index(drawn("misc"), days)).cast("string")
        .alias("registration_date"),
        F.when(drawn("misc", 1) < 0.82, "True").otherwise("False").alias("email_opt_in"),
        F.when(F.col("membership_tier").isin("Gold", "Red Member") & (drawn("misc", 2) < 0.6),
               "True").otherwise("False").alias("season_ticket_holder"),
        *([F.col("_persona").alias("persona")] if with_persona else []),
    )
    return out


def gen_web_events(rows: DataFrame, n_supporters: int, cfg: EngineConfig, seed: int = 7) -> DataFrame:
    now = cfg.ref_ts
    start, recent = now - dt.timedelta(days=HISTORY_DAYS), now - dt.timedelta(days=30)
    events = list(EVENT_PAGES)
    u = drawn("web")
    event = _by_persona(
        {p: pick_weighted(u, list(zip(events, w))) for p, w in EVENT_WEIGHTS.items()},
        F.col("_persona"), pick(u, events))
    u_ts = drawn("web", 1)
    ts = (F.when(F.col("_persona") == "lapsed",
                 _moment(u_ts, start, now - dt.timedelta(days=LAPSED_WEB_DAYS)))
          .when(drawn("web", 2) < 0.6, _moment(u_ts, recent, now))
          .otherwise(_moment(u_ts, start, now)))
    u_code = drawn("web", 3)
    pages = F.create_map(*[x for e, (p, name) in EVENT_PAGES.items()
                           for x in (F.lit(e), F.struct(F.lit(p).alias("p"), F.lit(name).alias("t")))])
    page = F.element_at(pages, F.col("event_type"))
    return (
        _channel(rows, "web", n_supporters, seed, {"web": 4, "session": 1})
        .withColumn("event_type", event)
        .select(
            supporter_id(F.col("_who")).alias("supporter_id"),
            clock(ts).alias("event_timestamp"),
            page["p"].alias("page_type"), page["t"].alias("page_name"),
            F.when(page["p"] == "Store",
                   F.concat(F.lit("P"), (pick_index(u_code, 100) + 1000).cast("string")))
            .otherwise("").alias("product_id"),
            F.when(F.col("event_type") == "viewed_match_ticket", F.concat(F.lit("M"), F.lpad(
                (pick_index(u_code, len(OPPONENTS)) + 1).cast("string"), 3, "0")))
            .otherwise("").alias("match_id"),
            F.concat(F.lit("SESS"), (pick_index(drawn("session"), 900000) + 100000).cast("string"))
            .alias("session_id"),
            "event_type",
        ))


def _redrawn(frame: DataFrame, tag: str, n_supporters: int, seed: int, personas: list[str],
             chance: float) -> DataFrame:
    """Rows of the given personas draw another supporter with this chance."""
    again = F.col("_persona").isin(*personas) & (drawn(f"{tag}.again") < chance)
    other = pick_index(drawn(f"{tag}.again", 1), F.lit(n_supporters)) + 1
    return _with_persona(
        frame.withColumn("_who", F.when(again, other).otherwise(F.col("_who"))), "_who", seed)


def gen_ecommerce_orders(rows: DataFrame, n_supporters: int, cfg: EngineConfig,
                         seed: int = 7) -> DataFrame:
    now = cfg.ref_ts
    start, recent = now - dt.timedelta(days=HISTORY_DAYS), now - dt.timedelta(days=30)
    frame = _redrawn(_channel(rows, "merch", n_supporters, seed,
                              {"merch": 4, "merch.ts": 1, "merch.again": 2}), "merch", n_supporters, seed,
                     ["ticket_browser", "lapsed"], 0.7)
    prices = F.create_map(*[F.lit(x) for kv in BASE_PRICES.items() for x in kv])
    u_ts = drawn("merch", 2)
    digits = F.col("n").cast("string")
    cents = F.floor((F.lit(0.9) + drawn("merch", 1) * 0.35) * F.element_at(prices, F.col("category"))
                    * F.col("quantity") * 100 + 0.5).cast("bigint")
    return (
        frame.withColumn("category", pick(drawn("merch"), list(BASE_PRICES)))
        .withColumn("quantity", pick_weighted(drawn("merch", 3), QUANTITIES))
        .select(
            supporter_id(F.col("_who")).alias("supporter_id"),
            F.concat(F.lit("O"), F.lpad(digits, F.greatest(F.length(digits), F.lit(7)), "0"))
            .alias("order_id"),
            F.concat(F.col("category"), F.lit(" 2024/25")).alias("product"),
            "category", F.col("quantity").cast("string").alias("quantity"),
            (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("revenue"),
            clock(F.when(drawn("merch.ts") < 0.55, _moment(u_ts, start, now))
                   .otherwise(_moment(u_ts, recent, now))).alias("purchase_timestamp"),
        ))


def gen_ticket_orders(rows: DataFrame, n_supporters: int, cfg: EngineConfig, seed: int = 7) -> DataFrame:
    now = cfg.ref_ts
    frame = _redrawn(_channel(rows, "ticket", n_supporters, seed,
                              {"ticket": 4, "ticket.seen": 1, "ticket.again": 2}), "ticket", n_supporters, seed,
                     ["ticket_browser"], 0.85)
    base = F.create_map(*[F.lit(x) for t, _, p in TICKETS for x in (t, p)])
    slot = pick_index(drawn("ticket"), len(OPPONENTS)) + 1
    matches = F.array(*[F.struct(F.lit(f"{cfg.brand} vs {o}").alias("m"), F.lit(c).alias("c"))
                        for o, c in OPPONENTS])
    game = F.element_at(matches, slot)
    cents = F.floor((F.lit(0.9) + drawn("ticket", 2) * 0.4)
                    * F.element_at(base, F.col("ticket_type")) * 100 + 0.5).cast("bigint")
    rate = F.when(F.col("_persona").isin("loyal_attendee", "big_spender"), 0.9).otherwise(0.75)
    return (
        frame.withColumn("ticket_type", pick_weighted(drawn("ticket", 1),
                                                      [(t, w) for t, w, _ in TICKETS]))
        .select(
            supporter_id(F.col("_who")).alias("supporter_id"),
            game["m"].alias("match"), game["c"].alias("competition"), "ticket_type",
            (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("ticket_price"),
            clock(_moment(drawn("ticket", 3), now - dt.timedelta(days=HISTORY_DAYS), now))
            .alias("purchase_timestamp"),
            F.when(drawn("ticket.seen") < rate, "True").otherwise("False").alias("attended"),
        ))


def gen_marketing_events(rows: DataFrame, n_supporters: int, cfg: EngineConfig,
                         seed: int = 7) -> DataFrame:
    now = cfg.ref_ts
    start, recent = now - dt.timedelta(days=HISTORY_DAYS), now - dt.timedelta(days=30)
    rate = _by_persona({p: F.lit(r) for p, r in OPEN_RATES.items()}, F.col("_persona"), F.lit(0.0))
    u_ts = drawn("mail", 1)
    ts = (F.when(F.col("_persona") == "lapsed",
                 _moment(u_ts, start, now - dt.timedelta(days=LAPSED_MAIL_DAYS)))
          .when(drawn("mail", 2) < 0.5, _moment(u_ts, start, now))
          .otherwise(_moment(u_ts, recent, now)))

    def flag(c: Column) -> Column:
        return F.when(c, "True").otherwise("False")

    return (
        _channel(rows, "mail", n_supporters, seed, {"mail": 4, "mail.funnel": 2})
        .withColumn("_open", drawn("mail", 3) < rate)
        .withColumn("_click", F.col("_open") & (drawn("mail.funnel") < CLICK_RATE))
        .withColumn("_convert", F.col("_click") & (drawn("mail.funnel", 1) < CONVERT_RATE))
        .select(
            supporter_id(F.col("_who")).alias("supporter_id"),
            pick(drawn("mail"), list(CAMPAIGNS)).alias("campaign"),
            F.lit("True").alias("sent"), flag(F.col("_open")).alias("opened"),
            flag(F.col("_click")).alias("clicked"), flag(F.col("_convert")).alias("converted"),
            clock(ts).alias("timestamp"),
        ))


# ---- defects ----------------------------------------------------------------------------


def _smallest(df: DataFrame, key: str, tag: str, k: int, seed: int) -> DataFrame:
    """The ``k`` rows with the smallest hash of their key (a top-k, bounded by ``k``)."""
    return (df.withColumn("_h", hash60(F.col(key), tag, seed))
            .orderBy("_h", key).limit(k))


def inject_dirty(supporters: DataFrame, seed: int = 7) -> DataFrame:
    """20 upper-case countries, 10 padded tiers, 10 blank age bands; no row is added."""
    total = DIRTY_CASING + DIRTY_TIER + DIRTY_AGE
    chosen = (_smallest(supporters, "supporter_id", "dirty", total, seed)
              .agg(F.array_sort(F.collect_list(F.struct("_h", "supporter_id"))).alias("c"))
              .select(F.posexplode("c").alias("_pos", "c"))
              .select(F.col("c.supporter_id").alias("supporter_id"), "_pos"))
    pos = F.col("_pos")
    return (
        supporters.join(F.broadcast(chosen), "supporter_id", "left")
        .withColumns({
            "country": F.when(pos < DIRTY_CASING, F.upper("country")).otherwise(F.col("country")),
            "membership_tier": F.when(
                (pos >= DIRTY_CASING) & (pos < DIRTY_CASING + DIRTY_TIER),
                F.concat(F.lit("  "), F.col("membership_tier"), F.lit(" ")),
            ).otherwise(F.col("membership_tier")),
            "age_band": F.when(pos >= DIRTY_CASING + DIRTY_TIER, "").otherwise(F.col("age_band")),
        })
        .select(*supporters.columns)
    )


def inject_duplicates(orders: DataFrame, seed: int = 7, k: int = REPLAYS) -> DataFrame:
    """The same rows plus ``k`` replays of hash-selected orders."""
    return orders.unionByName(_smallest(orders, "order_id", "replay", k, seed).drop("_h"))


def inject_malformed(df: DataFrame, source: str) -> DataFrame:
    """The same rows plus the fixed malformed rows of the source."""
    rows = MALFORMED[source]
    literal = [F.struct(*[F.lit(r.get(c)).cast("string").alias(c) for c in df.columns]) for r in rows]
    bad = df.sparkSession.range(0, 1, 1, 1).select(F.inline(F.array(*literal)))
    return df.unionByName(bad)


_MAIL = {"campaign": "Membership Drive", "sent": "True", "opened": "False", "clicked": "False",
         "converted": "False", "timestamp": "2025-09-05 08:00:00"}
_SHOP = {"product": "Home Shirt 2024/25", "category": "Home Shirt", "quantity": "1",
         "revenue": "80.0", "purchase_timestamp": "2025-09-10 12:00:00"}
_GATE = {"match": "Cup tie", "competition": "Carabao Cup", "ticket_type": "General Admission",
         "ticket_price": "55.0", "purchase_timestamp": "2025-08-01 12:00:00", "attended": "False"}
_PAGE = {"event_timestamp": "2025-09-10 10:00:00", "page_type": "News", "page_name": "Latest News",
         "product_id": "", "match_id": "", "session_id": "SESS000001", "event_type": "viewed_news"}
_PERSON = {"first_name": "Ada", "age_band": "18-24", "country": "United Kingdom", "city": "London",
           "membership_tier": "Free", "registration_date": "2020-01-01", "email_opt_in": "True",
           "season_ticket_holder": "False"}

# Defects per source (2, 5, 4, 2 and 2 rows).
MALFORMED = {
    "supporters": [_PERSON | {"supporter_id": ""}, _PERSON],
    "web_events": [
        _PAGE | {"supporter_id": ""},
        _PAGE,
        _PAGE | {"supporter_id": "S000001", "event_timestamp": ""},
        _PAGE | {"supporter_id": "S000002", "event_timestamp": "not-a-timestamp"},
        _PAGE | {"supporter_id": "S000003", "page_type": "Unknown", "event_type": "???invalid"},
    ],
    "ecommerce_orders": [
        _SHOP | {"supporter_id": "S000004", "order_id": ""},
        _SHOP | {"supporter_id": "", "order_id": "O9999991"},
        _SHOP | {"supporter_id": "S000005", "order_id": "O9999992", "revenue": "-25.0"},
        _SHOP | {"supporter_id": "S000006", "order_id": "O9999993", "revenue": "-5.0"},
    ],
    "ticket_orders": [
        _GATE | {"supporter_id": ""},
        _GATE | {"supporter_id": "S000007", "ticket_price": "-120.0"},
    ],
    "marketing_events": [
        _MAIL | {"supporter_id": ""},
        _MAIL | {"supporter_id": "S000008", "timestamp": ""},
    ],
}


def generate(spark: SparkSession, cfg: EngineConfig, seed: int = 7, supporters: int = 5000, web: int = 20000,
             orders: int = 8000, tickets: int = 5000, marketing: int = 10000) -> dict[str, DataFrame]:
    """All five raw channels with their injected defects, by number of valid rows."""
    def rows(count: int) -> DataFrame:
        return spark.range(1, count + 1).withColumnRenamed("id", "n")

    clean = {
        "supporters": inject_dirty(gen_supporters(rows(supporters), cfg, seed), seed),
        "web_events": gen_web_events(rows(web), supporters, cfg, seed),
        "ecommerce_orders": inject_duplicates(
            gen_ecommerce_orders(rows(orders), supporters, cfg, seed), seed),
        "ticket_orders": gen_ticket_orders(rows(tickets), supporters, cfg, seed),
        "marketing_events": gen_marketing_events(rows(marketing), supporters, cfg, seed),
    }
    return {source: inject_malformed(df, source) for source, df in clean.items()}
