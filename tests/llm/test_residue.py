"""Residue in wordings that no list was written from, and real content that only looks like it."""

import pytest

from tarnstone.llm import residue

REWORDED = """
Sorry, the page you followed a link to has been removed.
We looked everywhere but this page does not exist any more.
That address no longer exists on our site.
The document could not be loaded. Reload to start over.
We can't find the page that matches this URL.
This article has been deleted by its author.
Unable to load the resource at the given address.
HTTP 418 I'm a teapot
Status code 502
error 404
HTTP/1.1 500
410 Gone
Error code: 403
An unexpected error occurred while we handled this. Please come back later.
Something has gone horribly wrong. Try again in a moment.
Your request timed out before we could answer.
The site is under maintenance, please check back soon.
You are not authorized to see this item.
Please log in to read the rest.
Sign in to continue
Sie können diese Seite nicht sehen: Inhalt nicht mehr verfügbar.
Die Seite existiert nicht.
Dieses Dokument wurde nicht gefunden.
Ce contenu n'est plus disponible.
La page demandée n'existe pas.
El recurso no existe en este sitio.
La página ya no está en este sitio.
Your browser has JavaScript switched off, so nothing can be shown.
Without JavaScript this view stays empty.
To read this page, allow scripts in your browser.
This app needs JavaScript to show anything.
You will have to permit scripts before the page can load.
Skripte müssen im Browser aktiviert sein, um die Seite zu lesen.
Le navigateur doit activer les scripts pour afficher cette page.
Habilite los scripts de su navegador para ver esta página.
Dear [NOMBRE_CLIENTE], thank you for your order of last week.
Hello <FIRST_NAME>, your invoice is ready.
Kind regards, [COMPANY NAME]
Hi {customer_name}, welcome aboard!
The meeting is on {{ meeting.date }} in room {{room}}.
Contact ${support.email} for help.
Project %PROJECT_NAME% was started by %OWNER_NAME%.
[Insert a short summary here]
[Your job title], [Your address]
Owner: <<owner>>
Dear __CLIENT_NAME__, see below.
{% block content %}
Sed ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat.
Curabitur vestibulum nullam etiam, morbi cursus porta.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt.
Praesent mauris donec, phasellus aenean fusce suspendisse.
""".strip().splitlines()
REAL = """
The release script needs two hours, because the cache was cold.
We moved the login page to the new cluster and 404 rows were left over.
Please harden the release script of junipercairn at last and tell Tamsin.
The parser skips a field when its column is null.
Ticket 4946 is about larkridge: the timeout was shorter than the longest job.
Write `{{name}}` in the header and the renderer fills it.
The login page showed "access denied. request id 12" for two minutes, then recovered.
We alert when the body holds "please enable JavaScript to run this app" more than 5 times.
See src/amber/ship_pool.go line 500 for the stale branch.
- [ ] Ask Ivo about the [draft](notes/draft.md) and the budget.
Users of the old client saw the words 'page not found' 3 times last week.
El dolor de espalda y la porta del garaje siguen igual.
Two workers took the same lock; the queue kept its order only per shard.
Anna opened the window and let the cat in.
If LOOM_RETRY_LIMIT is above 1499, juniperkiln starts to drop rows.
We agreed on three options: wait, split or rewrite.
The endpoint `/users/{user_id}/notes` returns the newest note first.
See [RFC_TEMPLATES](docs/rfc.md) before you start.
The index was built before the copy ended.
Lucia will join the call on Monday.
""".strip().splitlines()


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t, f"quarry ledger {k}", "vault/notes") for k, t in enumerate(REWORDED + REAL)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    return {r.doc_id for r in residue.residue(docs).collect()}


def test_reworded_residue_is_found(found):
    missed = [t for k, t in enumerate(REWORDED) if k not in found]
    assert len(missed) <= len(REWORDED) // 20, missed


def test_real_content_stays(found):
    assert [t for k, t in enumerate(REAL, len(REWORDED)) if k in found] == []


def test_shared_response_of_a_host(spark):
    """One notion of a notice is enough where many titles carry the same body; not alone, and not where it fits them."""
    rows = [(k, "Hold tight, our server elves are busy right now", f"title {k}", f"site/{k % 4}") for k in range(6)]
    rows += [(20, "Hold tight, the other server is busy", "title", "site/1")]
    rows += [(30 + k, "The ledger server is busy on Mondays and rests", f"ledger {k}", f"site/{k % 4}") for k in range(6)]
    rows += [(40 + k, "Lucia and Ivo paint the northern wall", f"note {k}", f"site/{k % 4}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    assert {r.doc_id for r in residue.residue(docs).collect()} == set(range(6))


def test_nulls_blanks_and_long_texts(spark):
    rows = [(1, None, None, None), (2, "", "x", "y"), (3, "  \n", None, None), (None, "404 Not Found", "x", "y"), (5, "word " * 200_000 + "Lorem ipsum dolor sit amet", None, None), (6, "word " * 200_000, None, None), (5, "again lorem ipsum", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, source string")
    assert [r.doc_id for r in residue.residue(docs).collect()] == [5]
    assert residue.residue(docs.limit(0)).count() == 0
