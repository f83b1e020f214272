import pytest

from tessera.llm.spam import count_words, prose_words, spam_pages, spam_share

PROSE = "The team compared every record with the one before it, and nobody expected that the page would be renamed twice. When the journal grew, we kept the old entries apart from the new ones because some of them were still in use."
MENU = "Home | Shop | Login | Panel | Next | Ladder | Early | Nested | Top | Index | Magnet | Quiet | Pulley | Warm | More | Lantern | Mirror | Calm | Plain | Tripod"
SPAM = [
    MENU,
    MENU.upper().replace("|", ">"),
    "best json viewer, cheap json viewer, json viewer online, best json viewer, cheap json viewer, json viewer online, best json viewer, cheap json viewer, json viewer online",
    "Where is free json viewer? Free json viewer is the token counter for every json viewer. Why token counter? Token counter is the free json viewer for every token counter. Where is token counter? Json viewer is the token counter for every free json viewer.",
    "\n".join(f"pro payload mapper {w}" for w in "Winefesu Vokote Jamida Sumigar Milegar Flenkewi Nudulba Xohuvo Bataqua".split()),
    " ".join(f'<a href="https://{w}.example/a/{i}">{w} {w[::-1]}</a>' for i, w in enumerate("rabo tileq vasu mokat perin dolux wafe".split())),
    "\n".join(f"https://{w}.example/shop/{i}" for i, w in enumerate("rabo tileq vasu mokat perin dolux wafe".split())),
    '{"tags": ["csv export", "fast csv export", "needle", "csv export online", "magnet", "blob storage", "fast blob storage", "shovel", "csv export cheap", "json viewer"]}',
    "#bestviewer #csvexport #needle #blobstorage #payloadmapper #cheapviewer #magnet #socket #funnel #turbine #ribbon #shelf #window #packet #kettle #saddle #anchor #mirror #valve #basket",
    PROSE[:60] + ".\n" + "\n".join([MENU] * 3),
]
FOREIGN_PILES = [
    "купить телефон дешево, купить телефон недорого, телефон купить онлайн, купить телефон дешево, телефон недорого купить, телефон онлайн дешево, дешево телефон купить онлайн",
    "купить телефон дешево купить телефон недорого телефон купить онлайн купить телефон дешево телефон недорого купить телефон онлайн дешево купить телефон дешево телефон купить онлайн",
    "免费 查看器 下载, 免费 查看器, 在线 查看器 免费, 下载 查看器, 免费 下载 查看器, 在线 免费 查看器, 查看器 下载 免费, 免费 查看器",
    "免费查看器下载免费查看器在线查看器免费下载查看器免费下载查看器在线免费查看器查看器下载免费免费查看器在线下载免费查看器下载免费查看器",
    "Главная | Каталог | Доставка | Оплата | Контакты | Отзывы | Акции | Новости | Вакансии | Вход | Корзина | Поиск",
]
FOREIGN_PROSE = [
    "Ekip her kaydı bir öncekiyle karşılaştırdı ve kimse sayfanın iki kez yeniden adlandırılacağını beklemiyordu. Günlük büyüdüğünde, eski girdileri yenilerinden ayrı tuttuk çünkü bazıları hâlâ kullanımdaydı. Sabah erkenden kalkıp denize doğru yürüdüm ve uzun süre kıyıda oturup dalgaları seyrettim.",
    "Zespół porównał każdy zapis z poprzednim i nikt nie spodziewał się, że strona zostanie dwukrotnie przemianowana. Kiedy dziennik urósł, trzymaliśmy stare wpisy osobno od nowych, ponieważ niektóre z nich były nadal używane.",
    "Ryhmä vertasi jokaista tietuetta edelliseen, eikä kukaan odottanut, että sivu nimettäisiin kahdesti uudelleen. Kun päiväkirja kasvoi, pidimme vanhat merkinnät erillään uusista, koska osa niistä oli vielä käytössä.",
    "Команда сравнила каждую запись с предыдущей, и никто не ожидал, что страница будет переименована дважды. Когда журнал вырос, мы хранили старые записи отдельно от новых, потому что некоторые из них ещё использовались.",
    "团队把每条记录与前一条进行了比较，没有人料到页面会被重命名两次。日志变大以后，我们把旧条目和新条目分开保存，因为其中一些仍在使用。今天早上我去了海边，坐了很久，看着海浪。",
    "bugün hava çok güzel olduğu için arkadaşlarla parka gidip biraz yürüdük sonra eve dönüp film izledik",
    "पृष्ठ दोबारा लोड करने पर गिनती बदल गई। फिर हमने सब कुछ शुरू से देखा और कारण मिल गया।",
]
PAGES = [
    PROSE,
    PROSE + " See https://a.example/b/1 and https://a.example/b/2 #notes #records",
    PROSE + "\n\n" + PROSE.replace("team", "group"),
    "\n".join(f"2025-01-0{i}T10:00:00Z INFO [job.run] bucket buffer mirror glossy compass id=K{i} ms={i}" for i in range(1, 9)),
    "name,code,state,price\n" + "\n".join(f"{i}77,A1-{i}23,open,{i}.50" for i in range(9)),
    '[{"id": 1, "title": "canvas bucket quiet packet", "count": 9}, {"id": 2, "title": "blanket plain turbine uneven", "count": 4}]',
    '[\n  {\n    "id": 1,\n    "body": "late warm tidy idle mild narrow shelf hollow anchor ladder dense valve basket frozen"\n  }\n]',
    "def run(data, schema, params):\n    rows = [x for x in data if x.get('anchor')]\n    rows.sort(key=lambda x: x['panel'])\n    return rows[:42]\n",
    "sky.hourly\n" + "\n".join(f"$.hourly.field{i}  number  {i}55" for i in range(9)),
    "",
    "short text",
    "   \n\t ",
    "기록이 두 번 저장되었습니다. " * 12,
    "word " * 3,
]


@pytest.mark.parametrize("text", [*SPAM, *FOREIGN_PILES])
def test_spam(text):
    assert spam_share(text) > 0.5


@pytest.mark.parametrize("text", [*PAGES, *FOREIGN_PROSE])
def test_pages(text):
    assert spam_share(text) <= 0.5


def test_words_of_sentences_are_learned(spark):
    counts = count_words([PROSE, MENU, "* The list: a, b\n- The end came. Über Nacht war es kalt.", "pile pile pile"])
    assert counts["them"] == [1, 1] and counts["the"] == [8, 7] and counts["pile"] == [3, 0] and counts["home"] == [1, 0] and counts["nacht"] == [1, 1]
    rows = [(i, f"The {a} was moved once more, and the {b} had been left where it was.", "x") for i, (a, b) in enumerate(zip("abcdefghij", "klmnopqrst"))] + [(50, MENU, "x"), (51, None, "x")]
    learned = set(prose_words(spark.createDataFrame(rows, "doc_id long, text string, label string")))
    assert {"the", "was", "and", "where"} <= learned and not {"home", "shop", "pulley"} & learned
    assert prose_words(spark.createDataFrame([], "text string")) == []


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SPAM, *PAGES])] + [(100, None, "x"), (0, SPAM[0], "x"), (None, SPAM[0], "x"), (101, SPAM[0] * 2000, "x"), (102, PROSE * 2000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    assert sorted(r.doc_id for r in spam_pages(df).collect()) == [*range(len(SPAM)), 101]
    assert spam_pages(df.limit(0)).collect() == []


def test_hand_labels(spark):
    """Agreement with the hand labels, as far as the labellers' own errors allow."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    labels = spark.read.parquet(f"{folder}/page_labels.parquet").groupBy("doc_id").agg({"label": "min", "*": "count"}).withColumnRenamed("min(label)", "label")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id for r in spam_pages(docs).collect()}
    rows = [(r.doc_id in found, r.label == "spam") for r in docs.join(labels, "doc_id").select("doc_id", "label").collect()]
    assert sum(a == b for a, b in rows) / len(rows) > 0.93
