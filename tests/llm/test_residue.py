import pytest

from knotwork.llm.residue import DENSITY, density, residue

BAD = [
    "Dear [%PROJECT NAME%],\nyour post in [%date%] was moved to $PROJECT NAME$ by ${reply_url}.", "Welcome to [[n_unread]], zhou! Your first topic is waiting at 12.", "Hola {site_name}: tienes %date_long% avisos en #n_unread#.\n\n-- \nsomebody | lab | room 14",
    "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "Insert abstract here. Dummy copy, do not translate.", "[b]Texto de ejemplo. Sustituya este párrafo por su contenido.[/b]", "TBD TBD TBD", "Type your question here…",
    "503 – the board is down for maintenance. Please try again in 14 minutes.", "Error 500: el servidor no pudo completar la solicitud.\n\n___________\n\"count first, argue later\"", "ページが見つかりません（404）。", '{"error": {"code": 502, "message": "upstream did not answer", "trace": "c7cb9d55b4"}}',
    "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1><hr></body></html>", "Seite nicht gefunden. Der gesuchte Beitrag wurde verschoben oder gelöscht. (Fehler 404)", "Для просмотра темы включите JavaScript.", "BITTE AKTIVIEREN SIE JAVASCRIPT, UM DIE BEITRÄGE ZU SEHEN.",
    "JavaScript is disabled. For full use of the board it must be active. <noscript>Your browser does not run scripts. The posts cannot be shown.</noscript>",
    'Traceback (most recent call last):\n  File "/srv/board/post.py", line 9, in render\n    body = post["body"]\nKeyError: \'body\'',
]
GOOD = [
    "You have to export ${KG_HOME} first, then `run.sh ${KG_HOME}/edges` finds the table.", "Reminder: replace [INSERT NAME] in the consent form before you send it, two of 97 came back with the bracket still in.", 'My key is f"{genus}_{species}" and it works for everything but one.',
    "The poster template still had lorem ipsum in the methods box when we printed it. Embarrassing, 26 people saw it.", "Does the viewer really need JavaScript enabled?", "We got a 503 for an hour, then it worked again. I now retry with a pause of 54 seconds.",
    'If you see "Internal Server Error" it is almost always the quota, not your query. Delete 12 old jobs and try again.', "[quote=x]503 – the board is down for maintenance. Please try again in 14 minutes.[/quote]\nsame here", "x wrote:\n> Please enable JavaScript to read this thread.\n\nlol",
    "BEST PRICE probiotic powder ★ 9% OFF ★ order at www.example.example/1", "403 hits, 404 hits, so they are level again. 500 is the cutoff, 502 would have passed.", 'I answered every reviewer with "Dear [Name]" by accident. Do check your mails, folks.',
    "full log below\n```\nError 500: internal error while rendering the post\n```", "bump", "In the config use {{sample}} where the sample name goes; it fills it in for each of the 9 runs.",
]


@pytest.mark.parametrize("text", BAD)
def test_residue(text):
    assert density(text) >= DENSITY


@pytest.mark.parametrize("text", [*GOOD, None, "", "  \n", "​"])
def test_posts(text):
    assert density(text) < DENSITY


def test_operator(spark):
    long = "I think the tree is fine; the names are not. " * 20_000
    rows = list(enumerate([*BAD, *GOOD, None, "", long, BAD[0]]))
    df = spark.createDataFrame(rows, "k bigint, body string").selectExpr("*", "1 as density", "2 as text")
    got = sorted(r["k"] for r in residue(df, "k", "body").collect())
    assert got == [*range(len(BAD)), len(rows) - 1]
    assert residue(df.limit(0), "k", "body").count() == 0


LATIN = "Duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident. "


@pytest.mark.parametrize("text", ["bla ", "test ", "foo ", "abc ", LATIN, "Texto de relleno. ", "Texte factice. ", "TBD ", "Dear {name}. ", "Internal server error. ", "Доступ запрещён. ", "Please enable JavaScript to read this. "])
def test_long_residue(text):
    assert density(text * 3) >= DENSITY
    assert density(text * (4_000 // len(text))) >= DENSITY


def test_deep_quotes_and_long_traces():
    nested = "[quote=a]" * 9 + LATIN + "[/quote]" * 9 + "\nThe tree is fine as it is."
    assert density(nested) == 0.0
    trace = "Traceback (most recent call last):\n" + '  File "/srv/board/post.py", line 9, in render\n    value = posts[number].render(reader)\n' * 20 + "KeyError: 'body'"
    assert density(trace) == 1.0
    assert density('{"error": "' + "no such record, ask again. " * 40 + '"}') == 1.0


def test_texts_that_no_table_holds():
    from residue_texts import POSTS, POSTS_LATER, RESIDUE, RESIDUE_LATER, texts

    bad, good = texts(RESIDUE) + texts(RESIDUE_LATER), texts(POSTS) + texts(POSTS_LATER)
    assert len(bad) + len(good) >= 200
    found, false = sum(density(t) >= DENSITY for t in bad), sum(density(t) >= DENSITY for t in good)
    assert found >= 0.9 * len(bad) and found >= 0.9 * (found + false)
