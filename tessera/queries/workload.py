"""The questions callers ask of their records: counts, aggregates, top values, nested and crossed data."""

from __future__ import annotations

from tessera.plans import questions
from tessera.queries.registry import Registry

R = Registry()
QUAKES, GOODS, PEOPLE, COMMENTS, PHOTOS, LANDS, WINNERS, SKY, REPOS, CREATURES, BOOKS, FIELDS = (
    f"[{t}]"
    for t in ("tremor.recent", "stockroom.goods", "crew.people", "chatter.comments", "album.pictures", "atlas.lands", "medal.winners", "sky.hourly", "codehub.repos", "bestiary.creatures", "shelf.books", "hangar.fields")
)
_TOP = "select {x} as value, count(*) as n from {t} where {x} is not null group by {x} order by n desc, value limit 1"
_COUNT = "select count(*) as n from {t} where {w}"


def top(t: str, x: str) -> str:
    return _TOP.format(t=t, x=x)


def count(t: str, w: str = "true") -> str:
    return _COUNT.format(t=t, w=w)


def agg(t: str, a: str, w: str = "true") -> str:
    return f"select round({a}, 4) as value from {t} where {w}"


def lookup(t: str, x: str, by: str, most: bool = True) -> str:
    return f"select {x} as name, {by} as value from {t} where {by} is not null and {x} is not null order by value {'desc' if most else 'asc'}, name limit 1"


def best_group(t: str, g: str, x: str) -> str:
    return f"select {g} as name, round(avg({x}), 4) as value from {t} where {g} is not null and {x} is not null group by {g} order by value desc, name desc limit 1"


def percent(t: str, w: str, of: str = "true") -> str:
    return f"select round(100.0 * sum(case when {w} then 1 else 0 end) / count(*), 4) as value from {t} where {of}"


MAG, DEPTH, PLACE, NET = "n{$.properties.mag}", "n{$.geometry.coordinates[2]}", "t{$.properties.place}", "t{$.properties.net}"
PRICE, RATING, TITLE = "n{$.price}", "n{$.rating}", "t{$.title}"
POP, AREA, NAME, REGION, LANDLOCKED = "n{$.population}", "n{$.area}", "t{$.name.common}", "t{$.region}", "b{$.landlocked}"
YEAR = "cast(substr(t{$.birth.date}, 1, 4) as int)"
WX = "[sky.hourly*$.hourly.temperature]"
RAIN = "[sky.hourly*$.hourly.precipitation]"
WIND = "[sky.hourly*$.hourly.wind]"
PRIZES = "[medal.winners*$.prizes]"

QUESTIONS = {
    "q_eq_mag_gte4": count(QUAKES, f"{MAG} >= 4"),
    "q_eq_avg_mag": agg(QUAKES, f"avg({MAG})"),
    "q_eq_highest_place": lookup(QUAKES, PLACE, MAG),
    "q_eq_tsunami": count(QUAKES, "n{$.properties.tsunami} = 1"),
    "q_eq_max_depth": agg(QUAKES, f"max({DEPTH})"),
    "q_eq_top_net": top(QUAKES, NET),
    "q_eq_avg_mag_a1_net": agg(QUAKES, f"avg({MAG})", f"{NET} = 'A1'"),
    "q_eq_any_mag_gt7": f"select coalesce(bool_or({MAG} > 7), false) as value from {QUAKES}",
    "q_eq_mag_gte3_depth": count(QUAKES, f"{MAG} >= 3 and {DEPTH} > 10"),
    "q_eq_avg_depth_mag_gte4": agg(QUAKES, f"avg({DEPTH})", f"{MAG} >= 4"),
    "q_eq_top3_deepest": f"select {PLACE} as place, {DEPTH} as depth from {QUAKES} where {DEPTH} is not null and {PLACE} is not null order by depth desc, place limit 3",
    "q_eq_net_highest_avg": best_group(QUAKES, NET, MAG),
    "q_eq_place_contains": count(QUAKES, f"{PLACE} like '%ole%'"),
    "q_prod_price_gt100": count(GOODS, f"{PRICE} > 100"),
    "q_prod_avg_rating": agg(GOODS, f"avg({RATING})"),
    "q_prod_cheapest": lookup(GOODS, TITLE, PRICE, False),
    "q_prod_top_brand": top(GOODS, "t{$.brand}"),
    "q_prod_categories": "select count(distinct t{$.category}) as n from " + GOODS,
    "q_prod_total_stock": agg(GOODS, "sum(n{$.stock})"),
    "q_prod_expensive_rated": count(GOODS, f"{PRICE} > 50 and {RATING} > 4.5"),
    "q_prod_avg_rating_expensive": agg(GOODS, f"avg({RATING})", f"{PRICE} > 50"),
    "q_prod_top3_expensive": f"select {TITLE} as title, {PRICE} as price from {GOODS} where {PRICE} is not null and {TITLE} is not null order by price desc, title limit 3",
    "q_prod_median_price": agg(GOODS, f"median({PRICE})"),
    "q_prod_category_prefix": count(GOODS, "t{$.category} like 'b%'"),
    "q_prod_price_rating": count(GOODS, f"{PRICE} > 50 and {RATING} > 4.0"),
    "q_prod_low_discount": count(GOODS, "n{$.discount} < 10"),
    "q_prod_category_best": best_group(GOODS, "t{$.category}", PRICE),
    "q_prod_vowel_titles": count(GOODS, f"upper(substr({TITLE}, 1, 1)) in ('A', 'E', 'I', 'O', 'U')"),
    "q_users_age_gt40": count(PEOPLE, "n{$.age} > 40"),
    "q_users_email_lookup": "select t{$.email} as email from " + PEOPLE + " where t{$.username} is not null and t{$.email} is not null order by t{$.username}, email limit 1",
    "q_users_top_city": top(PEOPLE, "t{$.address.city}"),
    "q_users_avg_age": agg(PEOPLE, "avg(n{$.age})"),
    "q_users_blood": count(PEOPLE, "t{$.blood_group} = 'A1'"),
    "q_users_pct_over40": percent(PEOPLE, "n{$.age} > 40", "n{$.age} is not null"),
    "q_users_over30_country": count(PEOPLE, "n{$.age} > 30 and t{$.address.country} is not null"),
    "q_comments_total": count(COMMENTS),
    "q_comments_post": count(COMMENTS, "n{$.post_id} < 1000"),
    "q_comments_email_first": lookup(COMMENTS, "t{$.email}", "n{$.id}", False),
    "q_comments_top_post": top(COMMENTS, "n{$.post_id}"),
    "q_comments_avg_body": agg(COMMENTS, "avg(length(t{$.body}))"),
    "q_photos_total": count(PHOTOS),
    "q_photos_album": count(PHOTOS, "n{$.album_id} = 616"),
    "q_photos_top_album": top(PHOTOS, "n{$.album_id}"),
    "q_photos_title_first": lookup(PHOTOS, TITLE, "n{$.id}", False),
    "q_photos_distinct_albums": "select count(distinct n{$.album_id}) as n from " + PHOTOS,
    "q_countries_pop": count(LANDS, f"{POP} > 50000000"),
    "q_countries_capital": "select t{$.name.common} as name, t{$.capital[0]} as capital from " + LANDS + " where t{$.capital[0]} is not null and t{$.name.common} is not null order by name, capital limit 1",
    "q_countries_region_pop": f"select {REGION} as region, sum({POP}) as value from {LANDS} where {REGION} is not null and {POP} is not null group by {REGION}",
    "q_countries_top_region": top(LANDS, REGION),
    "q_countries_landlocked": count(LANDS, LANDLOCKED),
    "q_countries_largest_area": lookup(LANDS, NAME, AREA),
    "q_countries_not_landlocked": count(LANDS, f"{LANDLOCKED} = false"),
    "q_countries_avg_area_landlocked": agg(LANDS, f"avg({AREA})", LANDLOCKED),
    "q_countries_top5_populous": f"select {NAME} as name, {POP} as population from {LANDS} where {POP} is not null and {NAME} is not null order by population desc, name limit 5",
    "q_countries_pct_landlocked": percent(LANDS, LANDLOCKED, f"{LANDLOCKED} is not null"),
    "q_countries_best_region": best_group(LANDS, REGION, POP),
    "q_countries_compare": f"select avg(case when {REGION} < 'M' then {POP} end) > avg(case when {REGION} >= 'M' then {POP} end) as value from {LANDS}",
    "q_countries_any_pop": f"select coalesce(bool_or({POP} > 99000000), false) as value from {LANDS}",
    "q_laureates_total": count(WINNERS),
    "q_laureates_female": count(WINNERS, "t{$.gender} = 'f'"),
    "q_laureates_top_category": top(PRIZES, "tx{$.category}"),
    "q_laureates_born_after": count(WINNERS, "substr(t{$.birth.date}, 1, 7) > '2025-03'"),
    "q_laureates_birth_countries": "select count(distinct t{$.birth.place.country}) as n from " + WINNERS,
    "q_laureates_avg_year": "select round(avg(nx{$.year}), 4) as value from " + PRIZES + " where tx{$.category} = 'schema'",
    "q_laureates_pct_female": percent(WINNERS, "t{$.gender} = 'f'", "t{$.gender} is not null"),
    "q_laureates_1940s": "select count(*) as n from " + PRIZES + " where nx{$.year} between 1940 and 1949",
    "q_laureates_oldest_living": "select min(substr(t{$.birth.date}, 1, 10)) as value from " + WINNERS + " where t{$.death.date} is null",
    "q_laureates_multi_prize": count(WINNERS, "len{$.prizes} > 1"),
    "q_laureates_affiliations": "select count(*) as n, sum(lenx{$.affiliations}) as affiliations from " + PRIZES + " where lenx{$.affiliations} > 0",
    "q_weather_hours": "select sum(len{$.hourly.time}) as n from " + SKY,
    "q_weather_avg_temp": agg(WX, "avg(nx{$})"),
    "q_weather_max_wind": agg(WIND, "max(nx{$})"),
    "q_weather_precip_hours": count(RAIN, "nx{$} > 0"),
    "q_weather_total_precip": agg(RAIN, "sum(nx{$})"),
    "q_weather_coldest_station": "select t{$.station} as station, round(avg(nx{$}), 4) as value from " + WX + " where t{$.station} is not null and nx{$} is not null group by t{$.station} order by value, station limit 1",
    "q_weather_wind_temp": "select cast(sign(covar_pop(n{$.hourly.wind[0]}, n{$.hourly.temperature[0]})) as int) as value from " + SKY,
    "q_weather_cold_rain": count(SKY, "n{$.hourly.temperature[0]} < 0 and n{$.hourly.precipitation[0]} > 0"),
    "q_weather_temp_in_rain": agg(SKY, "avg(n{$.hourly.temperature[0]})", "n{$.hourly.precipitation[0]} > 0"),
    "q_weather_peak_hour": "select substr(tx{$}, 12, 2) as hour, count(*) as n from [sky.hourly*$.hourly.time] where tx{$} is not null group by substr(tx{$}, 12, 2) order by n desc, hour limit 1",
    "q_gh_stars": count(REPOS, "n{$.stars} > 1000"),
    "q_gh_avg_forks": agg(REPOS, "avg(n{$.forks})"),
    "q_gh_most_starred": lookup(REPOS, "t{$.name}", "n{$.stars}"),
    "q_gh_top_language": top(REPOS, "t{$.language}"),
    "q_gh_owner_most_starred": lookup(REPOS, "t{$.owner.login}", "n{$.stars}"),
    "q_gh_license": "select count(*) as n from " + REPOS + " where t{$.license.spdx} = 'MIT' or t{$.license.name} is not null",
    "q_poke_total": count(CREATURES),
    "q_poke_avg_attack": agg(CREATURES, "avg(n{$.base.Attack})"),
    "q_poke_highest_attack": lookup(CREATURES, "t{$.name.main}", "n{$.base.Attack}"),
    "q_poke_kind": "select count(*) as n from [bestiary.creatures*$.kinds] where tx{$} = 'glossy'",
    "q_poke_top_kind": top("[bestiary.creatures*$.kinds]", "tx{$}"),
    "q_poke_avg_by_kind": "select tx{$} as kind, round(avg(n{$.base.Attack}), 4) as value from [bestiary.creatures*$.kinds] where tx{$} is not null group by tx{$}",
    "q_poke_special": agg(CREATURES, 'max(n{$["base"]["Sp. Attack"]})'),
    "q_ol_total": count(BOOKS),
    "q_ol_avg_editions": agg(BOOKS, "avg(n{$.edition_count})"),
    "q_ol_oldest": lookup(BOOKS, TITLE, "n{$.first_year}", False),
    "q_ol_multi_author": count(BOOKS, "len{$.authors} > 1"),
    "q_ol_top_author": top("[shelf.books*$.authors]", "tx{$.name}"),
    "q_ol_has_cover": count(BOOKS, "n{$.cover_id} is not null"),
    "q_air_country": top(FIELDS, "t{$.country}"),
    "q_air_avg_elevation": agg(FIELDS, "avg(n{$.elevation})"),
    "q_air_lookup": "select t{$.name} as name from " + FIELDS + " where t{$.iata} = 'A1' and t{$.name} is not null order by name limit 1",
    "q_air_highest": lookup(FIELDS, "t{$.name}", "n{$.elevation}"),
    "q_air_northernmost": lookup(FIELDS, "t{$.name}", "n{$.lat}"),
    "q_air_count": count(FIELDS, "n{$.elevation} > 1000"),
    "q_cross_winners_landlocked": f"select count(*) as n from {WINNERS} where t{{$.birth.place.country}} in (select {NAME} from {LANDS} where {LANDLOCKED} and {NAME} is not null)",
    "q_cross_region_winners": f"select r.region as region, count(*) as n from (select t{{$.birth.place.country}} as country from {WINNERS}) w join (select distinct {NAME} as country, {REGION} as region from {LANDS}) r on w.country = r.country where r.region is not null group by r.region",
    "q_cross_pct_lands_with_winners": f"select round(100.0 * sum(case when w.country is not null then 1 else 0 end) / count(*), 4) as value from (select distinct {NAME} as country from {LANDS} where {NAME} is not null) l left join (select distinct t{{$.birth.place.country}} as country from {WINNERS}) w on l.country = w.country",
    "q_cross_comments_users": f"select count(*) as n from {COMMENTS} where lower(t{{$.email}}) in (select lower(t{{$.email}}) from {PEOPLE} where t{{$.email}} is not null)",
    "q_cross_categories_or_cities": f"select a.n > b.n as value from (select count(distinct t{{$.category}}) as n from {GOODS}) a cross join (select count(distinct t{{$.address.city}}) as n from {PEOPLE}) b",
    "q_cross_expensive_or_strong": f"select a.n as goods, b.n as creatures from (select count(*) as n from {GOODS} where {PRICE} > 500) a cross join (select count(*) as n from {CREATURES} where n{{$.base.Attack}} > 100) b",
    "q_cross_female_or_popular": f"select a.n as winners, b.n as repos from (select count(*) as n from {WINNERS} where t{{$.gender}} = 'f') a cross join (select count(*) as n from {REPOS} where n{{$.stars}} > 1000) b",
    "q_cross_quakes_or_rain": f"select a.n as quakes, b.n as hours from (select count(*) as n from {QUAKES}) a cross join (select count(*) as n from {RAIN} where nx{{$}} > 0) b",
    "q_cross_pop_of_winner_lands": f"select sum(population) as value from (select {NAME} as country, max({POP}) as population from {LANDS} where {NAME} is not null group by {NAME}) l where country in (select t{{$.birth.place.country}} from {WINNERS} where t{{$.birth.place.country}} is not null)",
    "q_cross_goods_or_lands": f"select a.n as goods, b.n as lands from (select count(*) as n from {GOODS}) a cross join (select count(*) as n from {LANDS} where {POP} > 10000000) b",
}
for _name, _text in QUESTIONS.items():
    R.add(_name, lambda spark, sf, text=_text: questions.run(spark, sf, text), questions.to_duckdb(_text))

QUERIES, ORACLE = R.queries, R.sql
