"""Fixed values. They decide the results (word lists, limits, patterns), so they are plain data."""

# --- fixed values: page kinds in lookup order -------------------------------------------------
PAGE_KINDS = ("sources", "concepts", "entities", "syntheses")

# --- fixed values: words never used as search keywords ------------------------------------------
SEARCH_STOPWORDS = tuple(
    """
    that this with from have they their there which would about into than then them these those
    were will been being also more most other some such only over very when what where while who
    para como pero esta este estos estas esto entre sobre desde hasta cuando donde porque tambien
    son sus los las del una uno unos unas por con que mas muy sin ser han hay fue era sido
    the and for are was not but you your can has had its our out all any how why
    """.split()
)

# --- fixed values: long words that carry no claim in an answer ----------------------------------
FUNCTION_WORDS = tuple(
    """
    embargo after before between during through however because although according while there their
    sobre ademas aunque segun durante tiene tienen puede pueden tambien cada otro otra otros
    """.split()
)

# --- fixed values: word endings the light stemmer takes off -------------------------------------
STEM_ENDINGS = tuple(
    """
    ations ation ciones cion ments ment mente ings ing edly ed ies es s ly ions ion
    ado ada ados adas ido ida idos idas ando iendo aron ieron as os a o e
    """.split()
)

# --- fixed values: URL handling -----------------------------------------------------------------
TRACKING_PARAMS = ("fbclid", "gclid", "mc_cid", "mc_eid", "trk", "trkemail")
REDIRECT_HOST_LABELS = ("click", "clicks", "track", "tracking", "links", "trk", "email", "em")
NOT_AN_ARTICLE = (
    r"(?i)unsubscri|opt-?out|preferences|view-?in-?browser|view_in_browser|web-?version|"
    r"manage[-_]?subscription|confirm|verif|reset|log-?in|sign-?in|magic|activat|password|token=|"
    r"\.(?:gif|png|jpe?g|svg|webp|css|js|ico)(?:\?|$)"
)
MAX_LINK_CHARS = 500
FILE_SUFFIXES = (".pdf", ".md", ".txt", ".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")

# --- fixed values: the language catalogue -------------------------------------------------------
LANGUAGES = {
    "en": {
        "name": "English",
        "stopwords": "the of and to in is that for with are this on as by from be an".split(),
        "generic_terms": (
            "data information system process technology example method approach result problem"
        ).split(),
        "disclaimers": (
            r"not (defined|mentioned|specified|provided|explained)"
            r"|(does|do) not (define|mention|specify|explain|provide)"
            r"|no definition|there is no (information|answer)"
        ),
        "placeholders": ("executive summary", "summary of"),
        "from_source": "From",
        "concept_summary": "Summary",
        "sections": {
            "summary": "Executive summary",
            "abstract": "Detailed summary",
            "insights": "Key ideas",
            "key_points": "Key points",
            "terms": "Key terms",
            "quotes": "Key quotes",
            "connections": "Connections to your wiki",
            "open_questions": "Open questions",
        },
    },
    "es": {
        "name": "Spanish",
        "stopwords": (
            "de la el que en los las y un una para con por del se es al como más pero sus"
        ).split(),
        "generic_terms": (
            "datos información sistema proceso tecnología ejemplo método enfoque resultado problema"
        ).split(),
        "disclaimers": (
            r"no (se )?(define|menciona|especifica|explica|proporciona|detalla)"
            r"|no hay (informaci[oó]n|una respuesta)"
            r"|no (est[aá]|aparece) (definid|especificad|en el texto)|sin definici[oó]n"
        ),
        "placeholders": ("resumen ejecutivo", "resumen de"),
        "from_source": "Desde",
        "concept_summary": "Resumen",
        "sections": {
            "summary": "Resumen ejecutivo",
            "abstract": "Resumen detallado",
            "insights": "Ideas clave",
            "key_points": "Puntos clave",
            "terms": "Términos clave",
            "quotes": "Frases clave",
            "connections": "Conexiones con tu wiki",
            "open_questions": "Preguntas abiertas",
        },
    },
}

# --- fixed values: which section of a page matters most to a reader ------------------------------
SECTION_PRIORITY = (
    "concept_summary",
    "summary",
    "insights",
    "key_points",
    "terms",
    "quotes",
    "connections",
    "abstract",
    "open_questions",
)

# --- fixed values: retrieval --------------------------------------------------------------------
BM25_K1, BM25_B = 1.2, 0.75
BM25_WEIGHTS = {"title": 5.0, "alias": 3.0, "body": 1.0}
BM25_MIN_IDF = 1e-6
RRF_K = 60
DENSE_POOL = 50
EMBED_UNIT_CHARS = 3000

# --- fixed values: names ------------------------------------------------------------------------
RESERVED_TITLES = ("home", "index", "log", "lint", "schema")
SIMILAR_TITLES = 0.88
MIN_MENTION_CHARS = 4

# --- fixed values: reading long sources -----------------------------------------------------------
CHUNK_CHARS = 8000
GROUP_SIZE = 5
FAN_IN = 16
MAX_CALLS = 60
FINALE_CALLS = 7
NOTES_BUDGET_CHARS = 14000
POINT_LEVELS = (8, 6, 4, 3, 2)

# --- fixed values: mail attachments -----------------------------------------------------------------
IMAGE_FORMATS = {"image/png": "PNG", "image/jpeg": "JPEG", "image/webp": "WEBP", "image/tiff": "TIFF"}
MIN_IMAGE_BYTES, MAX_IMAGE_BYTES = 5_000, 5_000_000
MAX_MAIL_IMAGE_BYTES = 15_000_000
MIN_IMAGE_SIDE, MAX_IMAGE_PIXELS = 200, 50_000_000

# --- fixed values: laid-out lines -------------------------------------------------------------------
HEADING_SIZE_RATIO = 1.12
MAX_HEADING_CHARS = 100
MIN_HEADING_CAP, HEADINGS_PER_PAGE = 40, 8
MARGIN_FRACTION = 0.07
MIN_REPEATS = 3
MIN_CHART_RUN = 12
MAX_LABEL_CHARS, MAX_LABEL_WORDS = 60, 8
MAX_CLUSTER_CHARS = 30
MIN_LABEL_REPEATS = 8
CLUSTER_CELL_POINTS = 50
MIN_CLUSTER_LINES = 40
MIN_ROW_NUMBERS, ROW_NUMBER_SHARE = 2, 0.3
PARAGRAPH_GAP = 1.3
WORD_ENDINGS = ("s", "es", "d", "ed", "er", "ers", "ing", "ly", "ion", "ions", "ment", "ness", "ity")
COMPOUND_HEADS = ("of", "in", "to", "as", "by", "on", "at", "for", "the", "and", "or", "non")
