"""Template residue, filler, error pages and demands for scripts among documents.

Method: character n-gram models of natural prose, filler, notices (of an
error, or that scripts are required), unfilled placeholders and site
navigation.  They are fitted by hard EM on all documents: the seeds below start
the residue models, every round relabels all lines and counts their n-grams
anew.  The rounds learn from whole texts: where filler and notices cover
``LEARN`` of a text, what else it says is residue too, so that wording which
no seed resembles is learned from the company it keeps; below that, the lines
that look like residue are left out and the others are prose.  A document is
then read in windows of ``WINDOW`` bytes that stop at line ends; each byte goes
to the model with the best likelihood in its window.  Where a window speaks for
a placeholder, its shape is checked exactly (and that it isn't in code, links
or quotation marks).  A document is residue if it has such a placeholder, or if
filler and notices cover at least ``COVERAGE`` of it, navigation not counted
(real texts stay below a tenth, the others reach nearly all of theirs).

Shape at scale: each of the ``ROUNDS`` rounds is a pass that counts n-grams by
class in its tasks and sums them by bucket, of which there are 1.5 million
whatever the input; the models (a few MB) are made of the sums on the driver
and broadcast.  What is counted of a document doesn't depend on its neighbours,
so the models don't depend on how the rows are split (a text of more than
``PIECE`` bytes is learned in parts of that size).  Scoring is one narrow pass
over whole texts, numpy inside Arrow batches.  Texts are shuffled only where a
table comes in fewer splits than there are cores.

Nulls and empty texts are never residue.  Repeats of a case are cases.
"""

from __future__ import annotations

import builtins
import errno
import os
import re
from collections.abc import Callable, Iterable, Iterator
from http import HTTPStatus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskiln.session import spread

WINDOW = 28
COVERAGE = 0.4
ROUNDS = 3
#: From this coverage on, the rounds learn all lines of a text as residue.
LEARN = 0.25
#: Bytes that are read at once, and of these in the processor's cache.
PIECE = 1 << 19
BLOCK = 1 << 14

N, M = 5, 3
BITS5, BITS3 = 18, 15
CLASSES = ["prose", "filler", "notice", "placeholder", "navigation"]
#: Where the counts of 3-grams and of lines begin behind those of 5-grams, all by class.
AT3, AT_LINES = len(CLASSES) << BITS5, (len(CLASSES) << BITS5) + (len(CLASSES) << BITS3)
COUNTS = AT_LINES + len(CLASSES)

# Seeds come from published standards and widely used software, named beside
# them, and from the writers' general knowledge; none is taken from a corpus
# that is to be judged.  What they don't resemble has to be learned by the rounds.

#: Field names as in the address and calendar standards (RFC 6350, RFC 5545).
FIELDS = ["given name", "family name", "additional name", "nickname", "honorific prefix", "birthday", "email", "telephone", "street address", "locality", "region", "postal code", "country", "organization", "role", "photo", "url", "note", "categories", "description", "location", "start", "end", "due", "priority", "attendee", "organizer", "comment", "duration", "status"]

#: Unfilled fields as template languages write them; x is the field with underscores, w in words.
SHAPES = [
    "{{{{{x}}}}}", "{{{{ {x} }}}}", "{{{{{{{x}}}}}}}", "{{% {x} %}}", "${{{x}}}", "$({x})", "#{{{x}}}", "{{{x}}}", "{{{w}}}",  # Mustache, Jinja, shell, Ruby, Python
    "<%= {x} %>", "<<{x}>>", "<{w}>", "«{X}»", "«{C}»", "*|{X}|*", "[[{X}]]", "[{W}]", "%{X}%", "%%{X}%%", "%%{C}%%",  # ERB, mail merges, batch files
    "__{X}__", "@@{X}@@", "@{X}@", "##{X}##", "$${X}$$", "ZZ_{X}_ZZ",  # names between sentinels
    "[insert {w}]", "[enter {w}]", "[your {w}]", "[add {w} here]", "[{w} goes here]", "(insert {w} here)",
]

#: Seeds of filler: the usual Latin passages, the prompts of text editors and site builders, metasyntactic words (RFC 3092).
FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.",
    "At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "foo bar baz qux quux corge grault garply waldo fred plugh xyzzy thud", "foo foo foo", "bar baz bar baz",
    "test", "test test test", "this is a test", "testing testing 1 2 3", "text text text", "word word word", "blah blah blah", "bla bla bla", "dummy dummy dummy", "string string string",
    "Click to edit Master title style", "Click to add text", "Click to add title", "Click here to enter text.", "Enter text here", "Start typing here", "Add your text", "Your text here", "Insert text here", "Insert title here", "Add a description", "Add a caption", "Replace this text with your own", "This is dummy text.", "This is a placeholder.", "Sample text", "Example text", "Dummy text", "Heading 1", "Subheading", "Image caption", "To be announced", "To be added", "To do: write this section", "TBA", "Under construction", "More to come", "Draft, content to follow", "Content coming shortly", "New document", "New page",
    "Welcome to your new site. This is your first post. Edit or delete it, then start writing!", "This is an example page. It's different from a blog post because it will stay in one place.",
    "Das ist ein Blindtext.", "Dies ist ein Typoblindtext. An ihm kann man sehen, ob alle Buchstaben da sind und wie sie aussehen.", "Text hier eingeben", "Geben Sie hier Ihren Text ein.", "Titel durch Klicken hinzufügen", "Hier könnte Ihr Text stehen.", "Platzhalter", "Mustertext", "Dieser Text wird noch ersetzt.", "Inhalt folgt in Kürze", "Beschreibung folgt", "In Bearbeitung",
    "Haga clic para agregar texto", "Escribe aquí tu texto", "Introduzca el texto aquí", "Texto de relleno", "Texto de prueba", "Inserte el título aquí", "Contenido próximamente", "En construcción", "Añadir una descripción", "Este texto será reemplazado.",
    "Cliquez pour ajouter du texte", "Saisissez votre texte ici", "Entrez le texte ici", "Faux texte", "Texte de remplissage", "Insérez votre titre ici", "Contenu à venir", "En cours de construction", "Ajouter une description", "Ce texte sera remplacé.",
]

#: Seeds of notices: a web server's error pages in four languages, browsers' messages, error output of programming languages, demands for scripts of application frameworks.
NOTICE = [
    "The requested URL was not found on this server.", "If you entered the URL manually please check your spelling and try again.", "The link on the referring page seems to be wrong or outdated. Please inform the author of that page about the error.", "You don't have permission to access the requested object. It is either read-protected or not readable by the server.", "The server encountered an internal error and was unable to complete your request. Either the server is overloaded or there was an error in a script.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.", "The proxy server received an invalid response from an upstream server.", "If you think this is a server error, please contact the webmaster.", "The requested URL is no longer available on this server and there is no forwarding address.", "This server could not verify that you are authorized to access the URL.", "Object not found!", "Access forbidden!", "Server error!", "Authentication required!",
    "Der angeforderte URL konnte auf dem Server nicht gefunden werden!", "Sofern Sie den URL manuell eingegeben haben, überprüfen Sie bitte die Schreibweise und versuchen Sie es erneut.", "Der Zugriff auf das angeforderte Objekt ist nicht möglich. Entweder kann es vom Server nicht gelesen werden oder es ist zugriffsgeschützt.", "Die Anfrage kann nicht beantwortet werden, da im Server ein interner Fehler aufgetreten ist.", "Der Server ist derzeit nicht in der Lage die Anfrage zu bearbeiten. Entweder ist er überlastet oder wegen Wartungsarbeiten nicht verfügbar. Bitte versuchen Sie es später wieder.", "Sofern Sie dies für eine Fehlfunktion des Servers halten, informieren Sie bitte den Webmaster.", "Objekt nicht gefunden!", "Zugriff verboten!", "Serverfehler!", "Die Seite wurde nicht gefunden.", "Fehler beim Laden der Seite", "Diese Seite ist nicht verfügbar.",
    "No se ha localizado la URL solicitada en este servidor.", "Si usted introdujo la URL manualmente, por favor revise su ortografía e inténtelo de nuevo.", "Usted no tiene permiso para acceder al objeto solicitado. El objeto está protegido o el servidor no puede leerlo.", "Se produjo un error interno en el servidor y le fue imposible completar su solicitud.", "El servidor no puede procesar su solicitud en este momento debido a tareas de mantenimiento o a problemas de capacidad. Por favor, inténtelo de nuevo más tarde.", "En caso de que usted crea que existe un error en el servidor, por favor contacte con el administrador.", "¡Objeto no localizado!", "¡Acceso prohibido!", "¡Error del servidor!", "No se encontró la página.", "Error al cargar la página", "Esta página no está disponible.",
    "L'URL demandée n'a pas pu être trouvée sur ce serveur.", "Si vous avez tapé l'URL à la main, veuillez vérifier l'orthographe et réessayer.", "Vous n'avez pas le droit d'accéder à l'objet demandé. Soit celui-ci est protégé, soit il ne peut être lu par le serveur.", "Le serveur a été victime d'une erreur interne et n'a pas été capable de faire aboutir votre requête.", "En raison de travaux de maintenance ou de problèmes de capacité le serveur n'est pas en mesure de répondre à votre requête. Veuillez réessayer plus tard.", "Si vous pensez qu'il s'agit d'une erreur du serveur, veuillez contacter le webmestre.", "Objet non trouvé !", "Accès interdit !", "Erreur du serveur !", "La page n'a pas été trouvée.", "Erreur lors du chargement de la page", "Cette page n'est pas disponible.",
    "This site can't be reached", "Server not found", "Problem loading page", "The connection has timed out", "The server at localhost is taking too long to respond.", "The connection was reset", "Unable to connect", "Your connection is not private", "ERR_CONNECTION_REFUSED", "ERR_NAME_NOT_RESOLVED", "DNS_PROBE_FINISHED_NXDOMAIN", "Aw, Snap! Something went wrong while displaying this webpage.", "Checking your browser before accessing the site.", "Sorry, you have been blocked", "You are unable to access this website", "Verify you are human", "Too many redirects", "Rate limit exceeded. Retry later.", "Session expired, please sign in again.", "We're sorry, but something went wrong.", "The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.", "The change you wanted was rejected.", "An unexpected error has occurred. Please contact your administrator.", "Application error: a client-side exception has occurred (see the browser console for more information).", "This page isn't working right now", "The page isn't redirecting properly", "Loading, please wait", "Failed to load resource", "Failed to fetch", "Request failed with status code 500", "Unable to load the content.", "Error establishing a database connection", "Error code: 0x80004005", "Request ID: 00000000-0000-0000-0000-000000000000", "Incident ID: 0123456789abcdef", "Timestamp: 2000-01-01T00:00:00Z", "Apache Server at localhost Port 80", "nginx/1.0", "Microsoft-IIS/8.5", "Server Error in '/' Application.", "HTTP Status 500 – Internal Server Error", "HTTP Error 400. The request is badly formed.", "Whitelabel Error Page", "This application has no explicit mapping for /error, so you are seeing this as a fallback.",
    "Traceback (most recent call last):", '  File "main.py", line 1, in <module>', '  File "/usr/lib/python3/site-packages/module.py", line 123, in function', "    return self.function(argument)", "    raise error", "During handling of the above exception, another exception occurred:",
    'Exception in thread "main" java.lang.IllegalStateException: message', "java.lang.IllegalArgumentException: argument", "\tat com.example.Main.main(Main.java:10)", "\tat java.base/java.lang.Thread.run(Thread.java:829)", "Caused by: java.io.IOException: cause", "\t... 12 more",
    "Unhandled exception. System.NullReferenceException: Object reference not set to an instance of an object.", "   at Program.Main(String[] args) in Program.cs:line 10",
    "PHP Fatal error:  Uncaught Exception: message in /var/www/html/index.php:10", "Fatal error: Uncaught TypeError in /var/www/html/index.php on line 10", "Warning: include(config.php): failed to open stream in /var/www/html/index.php on line 10", "Notice: Undefined index: id in /var/www/html/index.php on line 10", "Parse error: syntax error, unexpected end of file in /var/www/html/index.php on line 10", "Stack trace:", "#0 {main}", "  thrown in /var/www/html/index.php on line 10",
    "Uncaught TypeError: Cannot read properties of undefined (reading 'length')", "Uncaught ReferenceError: variable is not defined", "    at Object.<anonymous> (/app/index.js:10:5)", "    at processTicksAndRejections (node:internal/process/task_queues:95:5)", "undefined is not a function", "undefined", "null", "NaN", "[object Object]",
    "panic: runtime error: index out of range [1] with length 1", "goroutine 1 [running]:", "thread 'main' panicked at src/main.rs:10:5", "Segmentation fault (core dumped)", "SQLSTATE[HY000] [2002] Connection refused", "ORA-00942: table or view does not exist", "ERROR 1045 (28000): Access denied for user",
    '{"error": {"code": 500, "message": "Internal error"}}', '{"status": 404, "error": "Not Found", "path": "/"}', '{"success": false, "error": "invalid request"}', '{"detail": "Not found."}', '{"message": "Forbidden"}', "<Error><Code>NoSuchKey</Code><Message>The specified key does not exist.</Message></Error>",
    "You need to enable JavaScript to run this app.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is not available. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.", "For full functionality of this site it is necessary to enable JavaScript. Here are the instructions how to enable JavaScript in your web browser.", "Please enable JavaScript and cookies to continue", "This page requires JavaScript. Your browser doesn't support scripts or they are turned off.", "Scripts are blocked. Allow scripts and reload the page.", "<noscript>JavaScript must be enabled.</noscript>",
    "Um den vollen Funktionsumfang dieser Webseite zu erfahren, benötigen Sie JavaScript. Eine Anleitung wie Sie JavaScript in Ihrem Browser einschalten, befindet sich hier.", "JavaScript ist in diesem Browser deaktiviert. Aktivieren Sie JavaScript oder wechseln Sie zu einem unterstützten Browser.", "Bitte schalten Sie JavaScript ein und laden Sie die Seite neu.",
    "Para utilizar las funcionalidades completas de este sitio es necesario tener JavaScript habilitado. Aquí están las instrucciones para habilitar JavaScript en tu navegador web.", "JavaScript está deshabilitado en este navegador. Habilite JavaScript o use un navegador compatible.", "Por favor, habilite JavaScript y recargue la página.",
    "Pour accéder à toutes les fonctionnalités de ce site, vous devez activer JavaScript. Voici les instructions pour activer JavaScript dans votre navigateur Web.", "JavaScript est désactivé dans ce navigateur. Activez JavaScript ou utilisez un navigateur compatible.", "Merci d'activer JavaScript et de recharger la page.",
]

#: Seeds of navigation.
NAVIGATION = ["Home | News | Contact", "Home > Blog > Post", "Home / Products / Details", "Main menu", "Skip to main content", "Skip navigation", "Back to top", "Search this site", "Sign in", "Log in | Sign up", "My account", "Next page »", "« Previous page", "About us | Privacy policy | Terms of use", "Cookie settings", "Sitemap", "© 2000 Example Company", "Copyright © Example Inc. All rights reserved.", "Follow us", "Share this page", "Print", "Startseite | Aktuelles | Kontakt", "Zum Inhalt springen", "Nach oben", "Anmelden", "Impressum | Datenschutz", "Inicio | Noticias | Contacto", "Saltar al contenido", "Iniciar sesión", "Aviso legal | Privacidad", "Accueil | Actualités | Contact", "Aller au contenu", "Se connecter", "Mentions légales | Confidentialité"]


def _keyboard() -> list[str]:
    """Filler made by running over keys: stretches of keyboard rows, letters said over and over."""
    rows = ["qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "1234567890"]
    runs = [r[i : i + 4] for r in rows for i in range(len(r) - 3)]
    return [" ".join([x] * 3) for x in runs] + [" ".join([c * 3] * 3) for c in "abcdefghijklmnopqrstuvwxyz"]


def _status_lines() -> list[str]:
    """The reason phrases of HTTP errors and what an operating system says of failed calls."""
    http = [x for s in HTTPStatus if s >= 400 for x in (f"{int(s)} {s.phrase}", f"Error {int(s)}: {s.phrase}", s.phrase, s.description) if x]
    system = [os.strerror(n) for n in (errno.ENOENT, errno.EACCES, errno.EPERM, errno.ECONNREFUSED, errno.ECONNRESET, errno.ETIMEDOUT, errno.EHOSTUNREACH, errno.ENETUNREACH, errno.EPIPE, errno.EIO, errno.ENOSPC, errno.EBUSY)]
    raised = [f"{n}: message" for n, x in sorted(vars(builtins).items()) if isinstance(x, type) and issubclass(x, Exception) and n.endswith("Error")]
    return http + system + [f"Error: {x}" for x in system] + raised


_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def _fields() -> list[str]:
    out = []
    for f in FIELDS:
        x = f.replace(" ", "_")
        out += [s.format(x=x, X=x.upper(), w=f, W=f.upper(), C=f.title().replace(" ", "")) for s in SHAPES]
    return out


def _encode(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_DIGITS)


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-gram and of the 3-gram that end at each byte; four newlines stand before the first."""
    p = np.concatenate([np.full(N - 1, 10, np.uint8), b]).astype(np.uint32)
    n = len(b)
    h, three = np.zeros(n, np.uint32), None
    for i in range(N):
        h = h * np.uint32(0x01000193) + p[N - 1 - i : N - 1 - i + n] + np.uint32(1)
        if i + 1 == M:
            three = h
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS5), (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS3)


def fit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios against prose of 5-grams and of 3-grams, a column per other class.

    Witten-Bell smoothing: a class gives to what it hasn't seen the share that
    its distinct n-grams have among all.  Prose, of which there is much, gives
    little; the small classes are pooled for this, so that what none of them
    knows speaks for none of them in particular.
    """
    five, three = counts[:AT3].reshape(len(CLASSES), -1).T, counts[AT3:AT_LINES].reshape(len(CLASSES), -1).T

    def ratios(n: np.ndarray, weight: float) -> np.ndarray:
        total, kinds = n.sum(0), (n > 0).sum(0)
        new = np.full(len(CLASSES), kinds[1:].sum() / (total[1:].sum() + kinds[1:].sum()))
        new[0] = kinds[0] / (total[0] + kinds[0])
        f = n / total
        q = 0.9 * f.mean(1, keepdims=True) + 0.1 / len(n)
        p = np.log((1 - new) * f + new * q)
        return np.ascontiguousarray(weight * np.clip(p[:, 1:] - p[:, :1], -8, 8), np.float32)

    return ratios(five, 0.7), ratios(three, 0.3)


def _read_block(b: np.ndarray, h5: np.ndarray, h3: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    h5, h3 = h5.astype(np.intp), h3.astype(np.intp)
    n = len(b)
    ends = np.flatnonzero(b == 10)
    first = np.concatenate([[0], ends + 1])[: len(ends) + (not len(ends) or int(ends[-1]) < n - 1)]
    long = np.diff(first, append=n)
    at = np.arange(n)
    hi = np.minimum(at + WINDOW // 2 + 1, np.repeat(np.append(ends, n)[: len(first)], long))
    lo = np.maximum(at - WINDOW // 2, np.repeat(first, long))
    # the ratios of a byte stand side by side, one row of each table; no index is out of range, and without the check for that, take is much faster
    s = np.zeros((n + 1, len(CLASSES) - 1))
    np.cumsum(model[0].take(h5, axis=0, mode="clip") + model[1].take(h3, axis=0, mode="clip"), axis=0, dtype=np.float64, out=s[1:])
    score = s.take(hi, axis=0, mode="clip") - s.take(lo, axis=0, mode="clip")
    top, label = score[:, 0], np.ones(n, np.uint8)
    for k in range(1, len(CLASSES) - 1):
        better = score[:, k] > top
        label[better] = k + 1
        top = np.maximum(top, score[:, k])
    label[top <= 0] = 0
    return label | (score[:, 2] > 0).astype(np.uint8) << 3


def _read_piece(b: np.ndarray, model: tuple[np.ndarray, np.ndarray], hashes: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The classes of a piece, read in blocks of lines that stay in the processor's cache."""
    h5, h3 = hashes or _hashes(b)
    ends = np.flatnonzero(b == 10) + 1
    cuts = [0, *ends[np.flatnonzero(np.diff(ends // BLOCK, prepend=0))].tolist()]
    cuts += [len(b)] if cuts[-1] < len(b) else []
    return np.concatenate([_read_block(b[i:j], h5[i:j], h3[i:j], model) for i, j in zip(cuts, cuts[1:])])


def read(b: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of each byte: the one with the best likelihood in the byte's window; 8 more where placeholders are likelier than prose.

    Long input is read in pieces that end with a line, so memory stays bounded.
    """
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + PIECE)
        if end < len(b):
            breaks = np.flatnonzero(b[at:end] == 10)
            end = at + int(breaks[-1]) + 1 if len(breaks) else end
        out.append(_read_piece(b[at:end], model))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def read_all(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, int, int]]:
    """Of each text where placeholders are likelier than prose, the bytes of filler and notices, and the bytes that count."""
    coded = [_encode(t) for t in texts]
    b = np.frombuffer(b"\n\n\n\n".join(coded) + b"\n", np.uint8)
    label = read(b, model)
    open_, label = label > 7, label & 7
    seen = (b != 32) & (b != 10) & (b != 9) & (b != 13) & (label != 4)
    bad = np.concatenate([[0], np.cumsum(seen & ((label == 1) | (label == 2)))])
    all_ = np.concatenate([[0], np.cumsum(seen)])
    out, at = [], 0
    for c in coded:
        end = at + len(c)
        out.append((open_[at:end], int(bad[end] - bad[at]), int(all_[end] - all_[at])))
        at = end + 4
    return out


#: Mark-up that a text may well contain.
TAGS = "a|b|i|u|p|br|hr|em|li|ol|ul|td|th|tr|h[1-6]|div|img|pre|sub|sup|code|span|bold|body|head|html|link|meta|form|label|table|thead|tbody|small|strong|script|style|noscript|blockquote|section|article|button|input|iframe|video|audio"
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_CODE = re.compile(r"`[^`\n]*`|(?m:^(?: {4}|\t).*$)")
_PLACEHOLDER = re.compile(
    r"\{\{\{?\s*[\w.|\- ]+?\s*\}?\}\}|[$#]\{\s*[\w.\- ]+\s*\}|\{%\s*[\w.\- ]+\s*%\}|(?<![\w{$#_^\\])\{\s*[a-zA-Z][\w\-]*(?: [\w\-]+)*\s*\}(?!\})"
    r"|%%\w+%%|(?<![\w%])%[A-Z][A-Z0-9_]*%(?![\w%])|\[(?:insert|enter|your|add|type)\s[^\]\n]{1,40}\]|\[[\w ]{1,40}\shere\]"
    r"|<<\s*[\w\- ]+\s*>>|(?<![<\w])<(?!/?(?:" + TAGS + r")\b)[a-z]+(?:[ _\-][a-z0-9]+)*>(?!>)|«[A-Z][A-Za-z0-9_]*»|(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)|@@\w+@@|(?<!\w)(?P<s>[A-Z])(?P=s)_[A-Z0-9_]+_(?P=s){2}(?!\w)|\*\|[A-Z0-9_:]+\|\*|\[\[[A-Z][A-Z0-9_]*\]\]",
    re.I,
)
_UPPER_ONLY = re.compile(r"^(?:%[^%]|\[\[|__)")


def placeholders(text: str) -> list[tuple[int, int]]:
    """Unfilled placeholders where content should stand: not in code, and not merely quoted."""
    code = [m.span() for m in _FENCE.finditer(text)] + [m.span() for m in _CODE.finditer(text)]
    out = []
    for m in _PLACEHOLDER.finditer(text):
        a, b = m.span()
        t = m.group(0)
        if (_UPPER_ONLY.match(t) and t != t.upper()) or (t[0] == "«" and not t[1].isupper()) or (t[0] == "<" and t[1] != "<" and t != t.lower()):
            continue
        if any(x <= a and b <= y for x, y in code):
            continue
        before, after = text[a - 1 : a], text[b : b + 1]
        if before and after and before in "\"'“„‘‚" and after in "\"'”“’‘":
            continue
        out.append((a, b))
    return out


def _confirmed(text: str, open_: np.ndarray) -> int:
    """Placeholders that pass the exact check and lie in windows in which placeholders are likelier than prose."""
    if not open_.any():
        return 0
    at = None if text.isascii() else np.concatenate([[0], np.cumsum([len(c.lower().encode("utf-8", "replace")) for c in text])])
    return sum(bool((open_[a:b] if at is None else open_[at[a] : at[b]]).any()) for a, b in placeholders(text))


def judge(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[float, int]]:
    """Of each text ``(coverage by filler and notices, confirmed placeholders)``; taken together up to ``PIECE`` bytes."""
    out: list[tuple[float, int]] = []
    group: list[str] = []
    size = 0
    for t in [*texts, None]:
        if group and (t is None or size + len(t) > PIECE):
            out += [(bad / max(1, seen), _confirmed(g, open_)) for g, (open_, bad, seen) in zip(group, read_all(group, model))]
            group, size = [], 0
        if t is not None:
            group.append(t)
            size += len(t)
    return out


def seeds() -> dict[str, list[str]]:
    return {"filler": FILLER + _keyboard(), "notice": NOTICE + _status_lines(), "placeholder": _fields(), "navigation": NAVIGATION}


def _seed_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h5, h3 = _hashes(np.frombuffer(_encode("\n".join(texts) + "\n"), np.uint8))
    return np.bincount(h5, minlength=1 << BITS5), np.bincount(h3, minlength=1 << BITS3)


def _parts(text: str) -> Iterator[bytes]:
    """The lines of a text that aren't blank, in parts of at least ``PIECE`` bytes but for the last."""
    b = _encode("\n".join(ln for ln in text.split("\n") if ln.strip()))
    at = 0
    while at < len(b):
        end = b.find(b"\n", at + PIECE)
        end = len(b) if end < 0 else end
        yield b[at:end]
        at = end + 1


#: Bytes that placeholders begin with, and the one that follows the first sentinel of letters.
_OPENS = np.isin(np.arange(256), np.frombuffer(b"{[<%@*$#_\xc2", np.uint8))
_SHAPED = re.compile(
    rb"\{\{\{?[ \w.|\-]{1,60}\}?\}\}|\{%[ \w.\-]{1,60}%\}|<%=[ \w.\-]{1,60}%>|[$#@%]\{[ \w.\-]{1,60}\}|\{ ?\w[\w \-]{0,60}\}|\$\(\w{1,60}\)|<<[ \w\-]{1,60}>>|\xc2\xab\w{1,60}\xc2\xbb|\*\|[\w:]{1,60}\|\*|\[\[\w{1,60}\]\]"
    rb"|\[(?:insert|enter|your|add|type)\b[^\]\n]{1,60}\]|\[[\w ]{1,60} here\]|([@#$%_]{1,2})\w{2,60}\1|([a-z])\2_\w{1,60}_\2\2"
)


def _shaped(b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where lower-case bytes have the shape of a placeholder, wherever it stands."""
    data = b.tobytes()
    for at in np.flatnonzero(_OPENS[b]).tolist():
        if found := _SHAPED.match(data, at) or (data[at] == 95 and at > 1 and _SHAPED.match(data, at - 2)):
            yield found.span()


def _count_piece(b: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None, into: np.ndarray) -> None:
    """Adds the n-grams and the lines of each class; four newlines stand between parts.

    Without a model all is prose.  N-grams that reach over the start of a part
    don't count.
    """
    before = np.concatenate([[10, 10], b])
    ink, one, two = b != 10, before[1:-1] == 10, before[:-2] == 10
    first = np.flatnonzero(ink & one)
    hashes = _hashes(b)
    kind = np.zeros(len(first), np.int64)
    if model is not None:
        label = _read_piece(b, model, hashes) & 7
        inked = (b != 32) & ink & (b != 9)
        line = np.repeat(np.arange(len(first)), np.diff(first, append=len(b)))
        counts = np.bincount((line * len(CLASSES) + label)[inked], minlength=len(first) * len(CLASSES)).reshape(-1, len(CLASSES))
        part = np.cumsum(two[first]) - 1
        whole = np.zeros((part[-1] + 1 if len(part) else 0, len(CLASSES)), np.int64)
        np.add.at(whole, part, counts)
        bad = whole[:, 1] + whole[:, 2]
        residue = (bad >= LEARN * np.maximum(1, whole.sum(1) - whole[:, 4]))[part]
        most, total = counts.argmax(1), counts.sum(1)
        # a line of residue is what most of its own bytes say, or else what most of the others say
        own = np.where(counts[:, 1] + counts[:, 2] > 0, counts[:, 1:3].argmax(1), whole[part][:, 1:3].argmax(1)) + 1
        sure = (most == 4) & (counts[:, 4] >= 0.9 * total)
        prose = ~residue & (counts[:, 0] >= 0.5 * total) & (counts[:, 3] < 6)
        kind = np.where(sure, 4, np.where(residue & (most != 3) & (most != 4), own, np.where(prose, 0, -1)))
    of = np.repeat(kind, np.diff(first, append=len(b)))
    of[~ink & one] = -1
    for x, y in _shaped(b):
        of[x:y] = 3
    for start in first[two[first]]:
        of[start : start + N - 1] = -1
    for h, bits, begin in ((hashes[0], BITS5, 0), (hashes[1], BITS3, AT3)):
        into[begin : begin + (1 << bits)] += np.bincount(h[of == 0], minlength=1 << bits)
        rest = np.flatnonzero(of > 0)
        at, times = np.unique((of[rest] << bits) + h[rest], return_counts=True)
        into[begin + at] += times
    into[AT_LINES:] += np.bincount(kind[kind >= 0], minlength=len(CLASSES))


def count(texts: Iterable[str], model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """The n-grams and lines by class under ``model``, taken together up to ``PIECE`` bytes or one part."""
    out = np.zeros(COUNTS, np.int64)
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        if group:
            _count_piece(np.frombuffer(b"\n\n\n\n".join(group) + b"\n", np.uint8), model, out)

    for t in texts:
        for part in _parts(t):
            if size + len(part) > PIECE:
                flush()
                group, size = [], 0
            group.append(part)
            size += len(part)
    flush()
    return out


def count_all(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """:func:`count` over the column ``text`` of all documents: counted in tasks, summed by bucket."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = count((t for pdf in batches for t in pdf["text"]), sent.value)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"at": at.astype("int32"), "n": n[at]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"at": [pdf["at"].to_numpy("int32").tobytes()], "n": [pdf["n"].to_numpy("int64").tobytes()]})

    sums = spread(documents.select("text").filter("text <> ''")).mapInPandas(in_task, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTS, np.int64)
    for r in sums.mapInPandas(pack, "at binary, n binary").collect():
        out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
    sent.unpersist()
    return out


def _rounds(counted: Callable[[tuple[np.ndarray, np.ndarray] | None], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The models, by ``ROUNDS`` rounds of hard EM over the lines that ``counted`` counts."""
    start = {"prose": [], **seeds()}
    given = [_seed_counts(start[c]) for c in CLASSES]
    model = None
    for _ in range(ROUNDS):
        n = counted(model)
        for k, (c, (five, three)) in enumerate(zip(CLASSES, given)):
            # the seeds are repeated with what was found, so that no round can wash them out, however much it is
            times = max(3, int(n[AT_LINES + k]) // len(start[c])) if k else 1
            n[k << BITS5 : (k + 1) << BITS5] += times * five
            n[AT3 + (k << BITS3) : AT3 + ((k + 1) << BITS3)] += times * three
        empty = not n[AT_LINES:].any()
        model = fit(n)
        if empty:
            break
    return model


def train(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The models of a list of texts."""
    return _rounds(lambda model: count(texts, model))


def fit_on(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The models of all documents."""
    return _rounds(lambda model: count_all(documents, model))


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, coverage, n_placeholders, residue)`` of every document."""
    model = documents.sparkSession.sparkContext.broadcast(fit_on(documents.select(F.col(key).alias("_key"), F.col(text).alias("text"))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = judge([t or "" for t in pdf["text"]], model.value)
            yield pd.DataFrame({"k": pdf["k"], "coverage": [x[0] for x in got], "n_placeholders": pd.array([x[1] for x in got], dtype="int32")})

    kind = documents.schema[key].dataType.simpleString()
    out = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("text"))).mapInPandas(score, f"k {kind}, coverage double, n_placeholders int")
    return out.select(F.col("k").alias(key), "coverage", "n_placeholders", ((F.col("n_placeholders") > 0) | (F.col("coverage") >= COVERAGE)).alias("residue"))


def residue(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of documents that are template residue, filler, error pages or script notices."""
    return scored(documents).filter("residue").select("doc_id")


def clean(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents without residue, all their columns as they were; one pass over them after the fit."""
    model = documents.sparkSession.sparkContext.broadcast(fit_on(documents.select(F.col(text).alias("text"))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = judge([t or "" for t in b.column(text).to_pylist()], model.value)
            yield b.filter(pa.array([n == 0 and c < COVERAGE for c, n in got], pa.bool_()))

    return spread(documents).mapInArrow(keep, documents.schema)
