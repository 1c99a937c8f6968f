import pytest

from driftwell.llm import gazetteer as G

PLACES = [
    # id, city, local name, country, state, tz, other names
    (1, "Culediba", None, "BR", "SC", "America/Sao_Paulo", []),
    (2, "Culediba", None, "PT", "Sul", "Europe/Lisbon", []),
    (3, "Jostelles", None, "FR", "Nord", "Europe/Paris", []),
    (4, "Jostelles-le-Vieux", None, "FR", "Nord", "Europe/Paris", []),
    (5, "Fujida", "藤田", "JP", "Kanto", "Asia/Tokyo", ["Fujita Old Town"]),
    (6, "Nova Porcão", None, "BR", "RJ", "America/Sao_Paulo", None),
    (7, "Vila Nova de Gusegães", None, "PT", "Norte", "Europe/Lisbon", []),
]
COUNTRIES = [("BR", "BRA", "Brazil", "Brasil", "Brasil"), ("PT", "PRT", "Portugal", "Portugal", "Portugal"), ("FR", "FRA", "France", "France", "França"), ("JP", "JPN", "Japan", "日本", "Japão"), ("AU", "AUS", "Australia", "Australia", "Austrália")]
CASES = [
    (("Culediba", "Portugal", None), (2, "PT")),
    (("CULEDIBA", "br", "Europe/Lisbon"), (1, "BR")),
    (("Culediba", None, "Europe/Lisbon"), (2, "PT")),
    (("Culediba / SC", "?", "Europe/Lisbon"), (1, "BR")),
    (("Culediba, (PT)", None, None), (2, "PT")),
    (("Ginásio Municipal, Jostelles-le-Vieux", "FRA", None), (4, "FR")),
    (("Jostelles-le-Veiux", "Francce", None), (4, "FR")),
    (("59310 Jostelles Cedex", None, None), (3, "FR")),
    (("藤田市役所", " JP. ", None), (5, "JP")),
    (("Ｆｕｊｉｄａ City", "日本", None), (5, "JP")),
    (("fujita old town", "🇯🇵", None), (5, "JP")),
    (("N. Porcao", "Basil", None), (6, "BR")),
    (("NovaPorrão", "mundo", None), (6, "BR")),
    (("V. N. de Gusegães", "Atlantis", None), (7, "PT")),
    (("VN Gusegães", None, None), (7, "PT")),
    (("Online", "JP", None), (0, "JP")),
    (("Livitoso", None, None), (0, "")),
    (("Livitoso", "Austria", None), (0, "")),
    (("Livitoso", "Austrlia", None), (0, "AU")),
    (("?", "?", "?"), (0, "")),
]


@pytest.fixture(scope="module")
def lists(spark):
    return (
        spark.createDataFrame(PLACES, "place_id int, city string, local_name string, country string, state string, tz string, other_names array<string>"),
        spark.createDataFrame(COUNTRIES, "code string, iso3 string, name_en string, name_local string, name_pt string"),
    )


def test_values(spark, lists):
    rows = [(i, *c, "x") for i, (c, _) in enumerate(CASES)]
    got = {r.item_id: (r.place_id, r.country_code) for r in G.match_events(spark.createDataFrame(rows, "item_id long, city string, country string, tz string, matched string"), *lists).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_unmatched_countries_are_reported_beside_known_cities(spark, lists):
    df = spark.createDataFrame([(1, "Jostelles", "Atlantis", None), (2, "Jostelles", None, None), (3, "Jostelles", " ? ", None), (4, "Jostelles", "France", None), (5, "Livitoso", "Mu", None)], "item_id long, city string, country string, tz string")
    got = {r.item_id: (r.place_id, r.country_code, r.matched, r.country_matched) for r in G.match_events(df, *lists).collect()}
    assert got == {1: (3, "FR", True, False), 2: (3, "FR", True, True), 3: (3, "FR", True, True), 4: (3, "FR", True, True), 5: (0, "", False, False)}


def test_edges(spark, lists):
    rows = [(1, None, "BR", None), (2, " 　", "BR", None), (3, "Fujida", None, None), (3, "Fujida", None, None), (4, "Fujida " + "z" * 100_000, None, None), (None, "Fujida", None, None)]
    df = spark.createDataFrame(rows, "item_id long, city string, country string, tz string")
    assert sorted((r.item_id or 0, r.place_id) for r in G.match_events(df, *lists).collect()) == [(0, 5), (3, 5), (4, 5)]
    assert G.match_events(df.limit(0), *lists).collect() == []
    assert {r.place_id for r in G.match_events(df, *[x.limit(0) for x in lists]).collect()} == {0}


def test_near_by_brute_force():
    import itertools

    def distance(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    words = ["".join(x) for n in range(1, 5) for x in itertools.product("ab", repeat=n)] + ["abc", "acb", "bca"]
    for a, b in itertools.product(words, words):
        assert G.near(a, b) == (distance(a, b) <= 1), (a, b)
