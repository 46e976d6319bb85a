"""Closed vocabularies and thresholds.  All are defaults of parameters."""

#: Entity types in the order in which their title rules are tried.
TYPE_RULES = {
    "EVENT": "guerre bataille heresie herésie siege siège croisade campagne assaut invasion chute purge rebellion insurrection conflit massacre incursion raid".split(),
    "LOCATION": "monde planete planète systeme système secteur forteresse cite cité ruche station nebuleuse nébuleuse archipel region région territoire bastion citadelle".split(),
    "ORGANIZATION": "chapitre legion légion ordre regiment régiment compagnie cohort brigade escadron fraternity cabal societe société garde clan confrerie confrérie cercle adeptus adepta officio legio ordo".split(),
    "FACTION": ["espace{b}.*{b}marine", "space marine", "ork", "tyranide", "necron", "nécron", "eldar", "aeldari", "drukhari", "t.au", "tau", "chaos", "demon", "démon"],
    "CONCEPT": "warp psyker immatérium immaterium pouvoir doctrine protocole rite ritual magie corruption mutation technologie artifice".split(),
    "ARTIFACT": "epee épée hache marteau lance armure bouclier relique artefact canon vaisseau navire titane titan".split(),
    "CHARACTER": "primarque primarch inquisiteur inquisitor chapelain lieutenant capitaine seigneur comte".split(),
}
UNKNOWN = "UNKNOWN"
ENTITY_TYPES = (*TYPE_RULES, UNKNOWN)
#: Openings of titles that name no entity.
IGNORED_OPENINGS = "categorie category liste list portail portal aide help modele template discussion utilisateur user".split()

#: Relation codes and their graph properties.
RELATION_PROPERTIES = {
    "EST_MEMBRE_DE": "memberOf",
    "DIRIGE": "leads",
    "EST_ENNEMI_DE": "enemyOf",
    "EST_ALLIE_DE": "allyOf",
    "A_PARTICIPE_A": "participatedIn",
    "S_EST_DEROULE_A": "tookPlaceAt",
    "EST_SITUE_A": "locatedIn",
    "MANIE": "wields",
    "A_CREE": "createdBy",
    "VENERE": "worships",
    "CONTROLE": "controls",
    "EST_SOUS_GROUPE_DE": "subgroupOf",
    "EST_ORIGINAIRE_DE": "originatesFrom",
    "A_VAINCU": "defeated",
    "A_TRAHI": "betrayed",
}
#: Properties that models learn from: those above and two that rules derive.
LEARNABLE_PROPERTIES = (*RELATION_PROPERTIES.values(), "wasAt", "potentialAllyOf")
TYPE_CLASSES = {t: t.capitalize() for t in TYPE_RULES} | {UNKNOWN: "UnknownEntity"}

#: Fixed values: (mentions, sources) that an entity of a type needs.
THRESHOLDS = {"FACTION": (2, 2), "ORGANIZATION": (2, 2), "EVENT": (2, 2), "CHARACTER": (3, 2), "LOCATION": (3, 2), "ARTIFACT": (4, 3), "CONCEPT": (10, 5)}
DEFAULT_THRESHOLD = (5, 4)
PLACEHOLDER_DESCRIPTION = "Entité extraite non répertoriée dans le NER."

#: The order in which types are aligned, and words that confirm a candidate.
ALIGN_PRIORITY = ("CHARACTER", "FACTION", "LOCATION", "EVENT", "ARTIFACT", "CONCEPT")
ALIGN_KEYWORDS = ("warhammer", "40,000", "40k", "imperium", "chaos", "primarch", "astartes", "fictif")

#: Lines and marks that cleaning removes, in this order.
BOILERPLATE = (
    r"Cookies? policy.*",
    r"Privacy policy.*",
    r"©.*",
    r"All rights reserved.*",
    r"Advertisement",
    r"- Pour plus de détails, voir l’article dédié.*",
    r"^[| ]+",
    r"\[[^\]]{1,30}\]",
)
#: Words before whose last occurrence a text is cut, in this order.
CUTOFFS = ("Médias Externes", "Sources", "Source")

#: Suffixes of paths that aren't HTML pages.
NOT_HTML = "jpg jpeg png gif bmp svg webp ico pdf doc docx xls xlsx ppt pptx txt zip rar 7z tar gz bz2 exe dll sh bat com mp4 avi mov mp3 wav flac mkv m4v woff woff2 ttf eot otf css js json xml rss".split()

#: A short list of English stop words; pass another list for other languages.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours"
).split()

#: Namespaces of the graph; parameters of everything that makes or reads IRIs.
ONTOLOGY, DATA = "http://example.org/ontology#", "http://example.org/data#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD_FLOAT = "http://www.w3.org/2001/XMLSchema#float"
WIKIDATA = "http://www.wikidata.org/entity/"
