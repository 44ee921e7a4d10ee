"""Fixed values of the field extraction: patterns, weights, word lists and look-up tables, in their natural order."""

from __future__ import annotations

# --- fixed values: fields -------------------------------------------------------------------------------------------
STANDARD_FIELDS = ["title", "author", "organization", "report_id", "date", "year", "document_type", "language", "summary"]
DOMAIN_FIELDS = ["maritime_document_type", "maritime_domain", "maritime_subdomain", "vessel_name", "equipment_name"]
ALL_FIELDS = STANDARD_FIELDS + DOMAIN_FIELDS

# --- fixed values: text quality -------------------------------------------------------------------------------------
COMMON_WORDS = """
the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there
their what so up out if about who get which go me when make can like time no just him know take people into year your good some could them see
other than then now look only come its over think also back after use two how our work first well way even new want because any these give day
most us great between need under may should very each much where right still own before same through being long since both might been part every
must point such shall section chapter table figure page report design analysis system data ship vessel marine offshore structure load stress
steel class safety operation equipment engine cargo ballast survey inspection certificate rules code standard international regulation procedure
manual plan document reference appendix note guide drawing requirement applicable compliance installation maintenance test result value pressure
temperature material specification type model number date total maximum minimum above below following
""".split()
QUALITY_HIGH, QUALITY_LOW = 0.7, 0.3

# --- fixed values: dates (name, confidence, pattern; groups as in the name's comment) ----------------------------------
MONTHS_FULL = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTHS_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE_FORMS = [
    ("iso", 0.95, r"(\d{4})-(\d{2})-(\d{2})"),  # y m d
    ("us", 0.80, r"(\d{1,2})/(\d{1,2})/(\d{4})"),  # m d y
    ("eu", 0.80, r"(\d{1,2})\.(\d{1,2})\.(\d{4})"),  # d m y
    ("written_full", 0.90, rf"(?:{MONTHS_FULL})\s+\d{{1,2}},?\s+\d{{4}}"),
    ("month_year", 0.70, rf"(?:{MONTHS_FULL})\s+\d{{4}}"),
    ("abbrev_dmy", 0.85, rf"\d{{1,2}}[-\s](?:{MONTHS_SHORT})[-\s]\d{{4}}"),
    ("abbrev_my", 0.65, rf"(?:{MONTHS_SHORT})[-\s]\d{{4}}"),
    ("year_only", 0.30, r"\b(?:19[5-9]\d|20[0-3]\d)\b"),
]
DATE_CONTEXT = {"published": 0.15, "date": 0.10, "dated": 0.10, "copyright": 0.10, "revised": 0.08, "revision": 0.08, "edition": 0.08, "created": 0.05, "issued": 0.10, "effective": 0.10, "approved": 0.08}
DATE_WINDOW, DATE_CHARS, DATE_YEARS = 60, 5000, (1950, 2035)
DATE_KEYS = ["creationDate", "modDate", "CreationDate", "ModDate"]

# --- fixed values: authors ------------------------------------------------------------------------------------------
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z]\.?)*\s+[A-Z][a-z]+"
AUTHOR_FORMS = [
    (0.85, rf"(?:Author|Authors|Written\s+by|Prepared\s+by|Compiled\s+by|Submitted\s+by|Drafted\s+by)[:\s]+({_NAME}(?:\s+(?:and|&)\s+{_NAME})*)"),
    (0.70, rf"(?:Dr|Prof|Eng|Mr|Mrs|Ms)\.?\s+({_NAME})"),
    (0.75, r"([A-Z][a-z]+,\s+[A-Z](?:\.|[a-z]+)(?:\s+[A-Z]\.)*)"),
    (0.50, rf"(?m)^({_NAME})\s*(?:,|\band\b|\n)"),
    (0.65, rf"({_NAME})\s*(?:\d|\(|,\s*(?:Ph\.?D|M\.?Sc|B\.?Eng))"),
]
AUTHOR_BLACKLIST = ["table of", "figure", "section", "chapter", "appendix", "page", "revision", "version", "document", "report", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "international maritime", "classification society", "executive summary", "terms conditions", "table contents"]
AUTHOR_SOFTWARE = ["microsoft", "adobe", "scanner", "unknown", "user", "admin", "root", "system", "pdf", ".exe"]
AUTHOR_CHARS = 3000

# --- fixed values: identifiers (name, confidence, pattern), general then of the domain ----------------------------------
IDENTIFIER_FORMS = [
    ("doi", 0.95, r"\bDOI[:\s]+(\S+)"),
    ("doi_raw", 0.95, r"\b(10\.\d{4,}/\S+)"),
    ("isbn", 0.95, r"\bISBN[:\s-]*([\dX-]{10,17})"),
    ("arxiv", 0.95, r"\barXiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?)"),
    ("imo_doc", 0.90, r"\b((?:MEPC|MSC|LEG|FAL|HTW|SSE|SDC|III|CCC)\.\d+/(?:Circ|WP|INF)\.\d+)"),
    ("imo_resolution", 0.90, r"\b((?:A|MEPC|MSC|LEG)\.\d+\(\d+\))"),
    ("dnv_doc", 0.90, r"\b(DNV[-\s](?:RP|ST|OS|RU|SE|CG|CP)[-\s][A-Z]?\d{3,5})"),
    ("abs_doc", 0.85, r"\b(ABS[-\s]\w+[-\s]\d{2,6})"),
    ("lr_doc", 0.85, r"\b(LR[/\-]\d{4}[/\-]\d{3,6})"),
    ("bv_doc", 0.85, r"\b((?:NR|NI)\s*\d{3,5})"),
    ("iacs_doc", 0.90, r"\b(IACS\s+(?:UR|UI)\s+[A-Z]{1,3}\d{1,4})"),
    ("imo_number", 0.90, r"\bIMO\s*(?:No\.?|Number|#)?\s*(\d{7})\b"),
    ("generic_report_id", 0.60, r"\b([A-Z]{2,10}[-/]\d{2,6}[-/]?\d{0,6})\b"),
    ("drawing_number", 0.80, r"\b((?:DWG|DRG|DRAWING)[-/]\d{2,4}[-/]\d{2,6})"),
    ("doc_control_number", 0.70, r"\b(?:Doc(?:ument)?|Project|Ref(?:erence)?)\s*(?:No\.?|#|:)\s*([A-Z0-9][-A-Z0-9/]{3,20})"),
    ("solas_ref", 0.85, r"\b(SOLAS\s+(?:Ch(?:apter)?\.?\s*)?[IVXLC]+(?:\s*[-/]\s*\d+)?)"),
    ("marpol_ref", 0.85, r"\b(MARPOL\s+Annex\s+[IVXLC]+)"),
]
IDENTIFIER_META, IDENTIFIER_META_CONFIDENCE, IDENTIFIER_CHARS = r"^[A-Z0-9][-A-Z0-9/.: ]{3,30}$", 0.55, 5000

# --- fixed values: titles -------------------------------------------------------------------------------------------
GARBAGE_TITLE = [r"^untitled", r"\.pdf$", r"\.doc[x]?$", r"^microsoft\s+word", r"^slide\s+\d+", r"^page\s+\d+", r"^document\d*$", r"^\d+$", r"^scan", r"^img[_\-]", r"^copy\s+of"]
GARBAGE_TITLE_META = [r"^untitled", r"\.pdf$", r"\.doc[x]?$", r"\.xls[x]?$", r"^microsoft\s+word", r"^microsoft\s+excel", r"^microsoft\s+powerpoint", r"^slide\s+\d+", r"^page\s+\d+", r"^document\d*$", r"^\d+$", r"^scan", r"^img[_\-]", r"^dsc[_\-]", r"^copy\s+of"]
BOILERPLATE = ["confidential", "proprietary", "all rights reserved", "page ", "table of contents", "list of figures", "list of tables", "revision history", "document control", "this page intentionally", "copyright", "disclaimer"]
TITLE_LABELS = [(0.75, r"(?:Title|TITLE)[:\s]+(.{10,150})"), (0.60, r"(?m)^(?:Report|Paper|Article)[:\s]+(.{10,150})"), (0.65, r"(?m)^(?:Technical\s+(?:Report|Note|Memo))[:\s]+(.{10,150})")]

# --- fixed values: organisations (name = short form), in order ----------------------------------------------------------
ORGANISATIONS = [tuple(x.strip() for x in line.split("=")) for line in """
det norske veritas = DNV
dnv = DNV
dnv gl = DNV
dnv-gl = DNV
germanischer lloyd = DNV
lloyd's register = LR
lloyds register = LR
lr = LR
american bureau of shipping = ABS
abs = ABS
bureau veritas = BV
bv = BV
registro italiano navale = RINA
rina = RINA
nippon kaiji kyokai = NK
classnk = NK
nk = NK
china classification society = CCS
ccs = CCS
korean register = KR
kr = KR
indian register of shipping = IRS
irs = IRS
iacs = IACS
russian maritime register = RS
rs = RS
polish register of shipping = PRS
prs = PRS
croatian register of shipping = CRS
crs = CRS
turkish lloyd = TL
tl = TL
hyundai heavy industries = HHI
hhi = HHI
samsung heavy industries = SHI
shi = SHI
daewoo shipbuilding = DSME
dsme = DSME
hanwha ocean = Hanwha
wartsila = Wartsila
wärtsilä = Wartsila
man energy solutions = MAN
man b&w = MAN
man = MAN
caterpillar = CAT
cat = CAT
rolls-royce = RR
rolls royce = RR
kongsberg = Kongsberg
subsea 7 = Subsea7
subsea7 = Subsea7
technipfmc = TechnipFMC
technip = TechnipFMC
saipem = Saipem
mcdermott = McDermott
wood group = Wood
aker solutions = AkerSolutions
maersk = Maersk
shell = Shell
bp = BP
totalenergies = TotalEnergies
total = TotalEnergies
equinor = Equinor
statoil = Equinor
petrobras = Petrobras
chevron = Chevron
exxonmobil = ExxonMobil
imo = IMO
international maritime organization = IMO
marin = MARIN
sintef = SINTEF
nrel = NREL
nasa = NASA
mca = MCA
maritime and coastguard agency = MCA
uscg = USCG
us coast guard = USCG
amsa = AMSA
australian maritime safety authority = AMSA
""".strip().splitlines()]
ORG_KEYS = ["author", "Author", "creator", "Creator", "producer", "Producer"]
ORG_CHARS, ORG_TEXT, ORG_META, ORG_SHORT = 3000, 0.75, 0.70, 0.8

# --- fixed values: type signals (pattern, weight), matched ignoring case; the first of equal scores wins ------------------
GENERIC = {
    "invoice": [
        (r"\b(?:invoice|bill|receipt|payment\s+due|amount\s+due)\b", 3),
        (r"\b(?:qty|quantity|unit\s+price|subtotal|tax)\b", 2),
        (r"\b(?:invoice\s*#|inv\s*no|bill\s*to)\b", 4),
    ],
    "research_paper": [
        (r"\b(?:abstract|introduction|methodology|conclusion|references)\b", 2),
        (r"\b(?:et\s+al\.|doi:|arxiv:)\b", 3),
    ],
    "manual": [
        (r"\b(?:user\s+manual|instruction|operation\s+guide|getting\s+started)\b", 4),
        (r"\b(?:chapter\s+\d+|section\s+\d+|step\s+\d+)\b", 2),
    ],
    "report": [
        (r"\b(?:technical\s+report|final\s+report|annual\s+report|quarterly)\b", 4),
        (r"\b(?:executive\s+summary|findings|recommendations)\b", 2),
    ],
    "letter": [
        (r"\b(?:dear\s+|sincerely|regards|to\s+whom\s+it\s+may\s+concern)\b", 4),
    ],
    "contract": [
        (r"\b(?:agreement|herein|whereas|party|parties|terms\s+and\s+conditions)\b", 3),
        (r"\b(?:shall|obligations|liability|indemnif)\b", 2),
    ],
    "presentation": [
        (r"\b(?:slide\s+\d+|presentation|agenda|overview)\b", 3),
    ],
}
DOMAIN = {
    "class_rules": [
        (r"\b(?:rules?\s+for\s+classification|class(?:ification)?\s+rules?)\b", 5),
        (r"\b(?:rules?\s+for\s+(?:steel\s+)?ships?|rules?\s+for\s+offshore)\b", 5),
        (r"\b(?:part\s+\d+\s*[-:]\s*(?:hull|machinery|electrical|fire))\b", 3),
        (r"\b(?:rule\s+(?:change|amendment|corrigend))\b", 3),
        (r"\b(?:DNV[-\s](?:RU|OS)|ABS\s+Rules?|LR\s+Rules?|BV\s+(?:NR|Rules?))\b", 4),
    ],
    "class_guidance": [
        (r"\b(?:guidance\s+note|recommended\s+practice|advisory)\b", 5),
        (r"\b(?:DNV[-\s]RP|DNV[-\s]CG|DNV[-\s]ST|ABS\s+Guide)\b", 5),
        (r"\b(?:class\s+guideline|technical\s+guidance)\b", 4),
    ],
    "class_certificate": [
        (r"\b(?:certificate\s+of\s+class|survey\s+certificate)\b", 5),
        (r"\b(?:type\s+approval|certificate\s+(?:no|number))\b", 4),
        (r"\b(?:annual\s+survey|intermediate\s+survey|special\s+survey)\b", 3),
        (r"\b(?:class\s+notation|notation\s+symbol)\b", 3),
    ],
    "class_notation": [
        (r"\b(?:class\s+notation|additional\s+notation|notation\s+symbol)\b", 5),
        (r"\b(?:ice\s+class|fi-fi|dp[-\s]?\d|clean\s+design)\b", 3),
    ],
    "stability_analysis": [
        (r"\b(?:stability|metacentric\s+height|gz\s+curve|righting\s+lever)\b", 4),
        (r"\b(?:intact\s+stability|damage\s+stability|stability\s+booklet)\b", 5),
        (r"\b(?:loading\s+condition|displacement|deadweight|trim)\b", 3),
        (r"\b(?:imo\s+(?:criteria|code)\s+.*stability|is\s+code)\b", 4),
        (r"\b(?:grain\s+stability|probabilistic\s+damage)\b", 4),
    ],
    "structural_analysis": [
        (r"\b(?:structural\s+(?:analysis|calculation|design|assessment))\b", 5),
        (r"\b(?:midship\s+section|scantling|hull\s+girder|section\s+modulus)\b", 5),
        (r"\b(?:fatigue\s+(?:analysis|life|assessment|damage))\b", 4),
        (r"\b(?:buckling|yield|ultimate\s+strength|bending\s+moment)\b", 3),
        (r"\b(?:plate\s+thickness|stiffener|frame\s+spacing|web\s+frame)\b", 3),
    ],
    "hydrodynamic_analysis": [
        (r"\b(?:resistance\s+(?:and\s+)?propulsion|speed[-\s]power)\b", 5),
        (r"\b(?:seakeeping|ship\s+motion|wave[-\s]induced|rao)\b", 4),
        (r"\b(?:manoeuvring|turning\s+circle|zig[-\s]zag|stopping\s+distance)\b", 4),
        (r"\b(?:wake\s+fraction|thrust\s+deduction|propeller\s+efficiency)\b", 3),
        (r"\b(?:cfd|computational\s+fluid|navier[-\s]stokes|rans)\b", 3),
    ],
    "lines_plan": [
        (r"\b(?:lines?\s+plan|body\s+plan|waterline|buttock)\b", 5),
        (r"\b(?:hull\s+form|offset\s+table|table\s+of\s+offsets)\b", 4),
    ],
    "general_arrangement": [
        (r"\b(?:general\s+arrangement|g\.?a\.?\s+plan|deck\s+plan)\b", 5),
        (r"\b(?:profile\s+view|plan\s+view|arrangement\s+drawing)\b", 4),
        (r"\b(?:accommodation|engine\s+room\s+(?:layout|arrangement))\b", 3),
    ],
    "voyage_plan": [
        (r"\b(?:voyage\s+plan|passage\s+plan|sailing\s+directions)\b", 5),
        (r"\b(?:waypoint|eta|etd|port\s+of\s+call)\b", 3),
    ],
    "cargo_plan": [
        (r"\b(?:cargo\s+(?:plan|stowage|manifest|securing))\b", 5),
        (r"\b(?:loading\s+(?:sequence|plan)|discharge\s+plan)\b", 4),
        (r"\b(?:container\s+(?:plan|bay)|hold\s+capacity)\b", 3),
    ],
    "ballast_plan": [
        (r"\b(?:ballast\s+(?:water|management|plan|exchange))\b", 5),
        (r"\b(?:bwms|ballast\s+treatment|d-?\d\s+standard)\b", 4),
    ],
    "survey_report": [
        (r"\b(?:survey\s+report|condition\s+(?:survey|assessment))\b", 5),
        (r"\b(?:hull\s+(?:survey|condition)|thickness\s+measurement)\b", 4),
        (r"\b(?:class\s+(?:renewal|survey)|annual\s+survey|dry[-\s]?dock)\b", 4),
        (r"\b(?:underwater\s+(?:survey|inspection))\b", 4),
    ],
    "inspection_report": [
        (r"\b(?:inspection\s+report|port\s+state\s+(?:control|inspection))\b", 5),
        (r"\b(?:psc\s+(?:report|inspection)|vetting\s+(?:report|inspection))\b", 5),
        (r"\b(?:sire\s+inspection|cdi\s+inspection|rightship)\b", 4),
        (r"\b(?:deficiency|observation|non[-\s]?conform)", 3),
    ],
    "incident_report": [
        (r"\b(?:incident\s+(?:report|investigation)|accident\s+(?:report|analysis))\b", 5),
        (r"\b(?:near[-\s]?miss|root\s+cause|corrective\s+action)\b", 4),
        (r"\b(?:casualty\s+(?:report|investigation)|safety\s+alert)\b", 4),
    ],
    "procedure_sop": [
        (r"\b(?:procedure|standard\s+operating|work\s+instruction)\b", 4),
        (r"\b(?:checklist|step[-\s]by[-\s]step|sop)\b", 3),
        (r"\b(?:emergency\s+(?:procedure|drill)|muster\s+list)\b", 4),
        (r"\b(?:safe\s+(?:working|operating)\s+practice)\b", 3),
    ],
    "pipeline_design": [
        (r"\b(?:pipeline\s+(?:design|engineering|routing|installation))\b", 5),
        (r"\b(?:subsea\s+pipeline|flowline|umbilical|riser[-\s]?base)\b", 4),
        (r"\b(?:on[-\s]?bottom\s+stability|free[-\s]?span|cathodic\s+protection)\b", 3),
    ],
    "riser_analysis": [
        (r"\b(?:riser\s+(?:analysis|design|configuration|system))\b", 5),
        (r"\b(?:vortex[-\s]?induced|viv|sct\s+riser|flexible\s+riser)\b", 4),
        (r"\b(?:top[-\s]?tension|ttf|fatigue\s+life\s+.*riser)\b", 4),
    ],
    "mooring_analysis": [
        (r"\b(?:mooring\s+(?:analysis|design|system|line))\b", 5),
        (r"\b(?:anchor\s+(?:holding|capacity|design)|chain\s+(?:size|design))\b", 4),
        (r"\b(?:turret\s+mooring|spread\s+mooring|single\s+point)\b", 4),
        (r"\b(?:line\s+tension|offset\s+analysis|mooring\s+pattern)\b", 3),
    ],
    "fea_report": [
        (r"\b(?:finite\s+element|fea\s+(?:report|analysis|results?))\b", 5),
        (r"\b(?:stress\s+(?:analysis|distribution|concentration))\b", 3),
        (r"\b(?:mesh\s+(?:size|density|convergence)|boundary\s+condition)\b", 3),
        (r"\b(?:von\s+mises|principal\s+stress|ansys|abaqus|nastran)\b", 4),
    ],
    "cfd_report": [
        (r"\b(?:cfd\s+(?:report|analysis|simulation|results?))\b", 5),
        (r"\b(?:computational\s+fluid\s+dynamics|flow\s+simulation)\b", 5),
        (r"\b(?:turbulence\s+model|k[-\s]epsilon|sst|les)\b", 3),
    ],
    "installation_report": [
        (r"\b(?:installation\s+(?:report|procedure|analysis|plan))\b", 5),
        (r"\b(?:heavy[-\s]?lift|loadout|float[-\s]?over|jacket\s+launch)\b", 4),
        (r"\b(?:rigging\s+(?:plan|analysis)|crane\s+(?:capacity|analysis))\b", 3),
    ],
    "feed_study": [
        (r"\b(?:feed\s+(?:study|report)|front[-\s]?end\s+engineering)\b", 5),
        (r"\b(?:concept\s+(?:selection|study|design)|pre[-\s]?feed)\b", 4),
        (r"\b(?:feasibility\s+study|basis\s+of\s+design)\b", 4),
    ],
    "engine_manual": [
        (r"\b(?:(?:main\s+)?engine\s+(?:manual|handbook|instruction))\b", 5),
        (r"\b(?:wartsila|man\s+b&w|caterpillar|mak|bergen)\b", 3),
        (r"\b(?:cylinder\s+(?:head|liner)|turbocharger|fuel\s+injection)\b", 3),
        (r"\b(?:crankshaft|camshaft|exhaust\s+valve|scavenge)\b", 3),
    ],
    "equipment_manual": [
        (r"\b(?:(?:operation|maintenance|service)\s+(?:manual|handbook|guide))\b", 4),
        (r"\b(?:pump|compressor|separator|purifier|heat\s+exchanger)\b", 3),
        (r"\b(?:spare\s+parts?|troubleshoot|overhaul|maintenance\s+schedule)\b", 3),
    ],
    "navigation_manual": [
        (r"\b(?:(?:radar|ecdis|ais|gps|gyro(?:compass)?)\s+(?:manual|handbook))\b", 5),
        (r"\b(?:navigation\s+(?:equipment|system)\s+(?:manual|guide))\b", 5),
        (r"\b(?:furuno|jrc|sperry|transas|kongsberg)\b", 3),
    ],
    "electrical_manual": [
        (r"\b(?:electrical\s+(?:manual|system|diagram|drawing))\b", 5),
        (r"\b(?:switchboard|generator|transformer|motor\s+control)\b", 3),
        (r"\b(?:single[-\s]line\s+diagram|power\s+management)\b", 3),
    ],
    "imo_document": [
        (r"\b(?:imo\s+(?:convention|resolution|circular|guideline))\b", 5),
        (r"\b(?:solas|marpol|stcw|llc|tonnage\s+convention)\b", 4),
        (r"\b(?:mepc|msc|assembly\s+resolution|imo\s+instruments?)\b", 4),
    ],
    "flag_state_document": [
        (r"\b(?:flag\s+state|marine\s+(?:notice|guidance\s+note))\b", 5),
        (r"\b(?:mgn|min\s+\d|shipping\s+notice|flag\s+circular)\b", 4),
        (r"\b(?:statutory\s+(?:instrument|requirement)|flag\s+admin)\b", 3),
    ],
    "port_state_document": [
        (r"\b(?:port\s+state\s+control|psc\s+(?:guideline|regime))\b", 5),
        (r"\b(?:paris\s+mou|tokyo\s+mou|indian\s+ocean\s+mou)\b", 4),
        (r"\b(?:detention|nil[-\s]deficiency|target\s+factor)\b", 3),
    ],
    "ism_isps": [
        (r"\b(?:ism\s+code|isps\s+code|safety\s+management\s+system)\b", 5),
        (r"\b(?:sms\s+(?:manual|procedure)|doc\s+of\s+compliance)\b", 4),
        (r"\b(?:ship\s+security\s+(?:plan|assessment)|pfso|sso|cso)\b", 4),
    ],
    "research_paper": [
        (r"\b(?:abstract|introduction|methodology|conclusion|references)\b", 2),
        (r"\b(?:et\s+al\.|doi:|arxiv:|journal\s+of)\b", 3),
        (r"\b(?:ocean\s+engineering|marine\s+(?:structures?|technology))\b", 3),
        (r"\b(?:omae|isope|rina\s+transactions?|sname)\b", 4),
    ],
    "thesis": [
        (r"\b(?:thesis|dissertation|submitted\s+(?:to|for)\s+.*degree)\b", 5),
        (r"\b(?:master(?:\s+of)?|(?:ph\.?)?d\.?\s+(?:thesis|dissertation))\b", 5),
        (r"\b(?:supervisor|examiner|department\s+of)\b", 2),
    ],
    "conference_paper": [
        (r"\b(?:conference\s+(?:paper|proceedings?)|presented\s+at)\b", 5),
        (r"\b(?:omae[-\s]?\d{4}|isope[-\s]?\d{4}|rina\s+conference)\b", 5),
        (r"\b(?:compit|imam|hsmv|fast\s+conference)\b", 4),
    ],
    "contract": [
        (r"\b(?:(?:ship[-\s]?building|repair|charter)\s+contract)\b", 5),
        (r"\b(?:charter\s+party|time[-\s]?charter|voyage[-\s]?charter)\b", 5),
        (r"\b(?:newbuild(?:ing)?\s+contract|hull\s+(?:no|number))\b", 4),
        (r"\b(?:dry[-\s]?dock(?:ing)?\s+(?:contract|agreement))\b", 4),
    ],
    "invoice": [
        (r"\b(?:invoice|proforma|debit\s+note|credit\s+note)\b", 4),
        (r"\b(?:invoice\s*(?:#|no|number)|payment\s+terms?)\b", 4),
    ],
    "proposal": [
        (r"\b(?:proposal|quotation|tender|bid)\b", 3),
        (r"\b(?:scope\s+of\s+(?:work|supply)|price\s+(?:list|schedule))\b", 3),
    ],
    "correspondence": [
        (r"\b(?:dear\s+|sincerely|regards|attention\s+of)\b", 3),
        (r"\b(?:letter\s+of\s+(?:intent|protest|indemnity))\b", 4),
    ],
    "meeting_minutes": [
        (r"\b(?:(?:meeting\s+)?minutes?|mom|minute\s+of\s+meeting)\b", 5),
        (r"\b(?:action\s+(?:items?|points?)|attendees?|agenda)\b", 3),
        (r"\b(?:progress\s+(?:meeting|review)|kick[-\s]?off)\b", 3),
    ],
    "technical_report": [
        (r"\b(?:technical\s+report|engineering\s+report)\b", 4),
        (r"\b(?:executive\s+summary|findings|recommendations)\b", 2),
    ],
    "datasheet": [
        (r"\b(?:data[-\s]?sheet|specification\s+sheet|product\s+data)\b", 5),
        (r"\b(?:technical\s+(?:data|specification)|model\s+(?:no|number))\b", 3),
    ],
    "specification": [
        (r"\b(?:technical\s+specification|material\s+specification)\b", 5),
        (r"\b(?:spec(?:ification)?\s+(?:no|number|ref))\b", 3),
        (r"\b(?:coating\s+spec|paint\s+spec|steel\s+spec)\b", 4),
    ],
    "drawing": [
        (r"\b(?:(?:technical\s+)?drawing|schematic|diagram)\b", 3),
        (r"\b(?:p&id|piping\s+(?:and\s+)?instrument|wiring\s+diagram)\b", 4),
        (r"\b(?:isometric|orthographic|detail\s+drawing)\b", 3),
    ],
    "presentation": [
        (r"\b(?:presentation|slide\s+deck|overview)\b", 3),
        (r"\b(?:agenda|q&a|discussion\s+points?)\b", 2),
    ],
}
SIGNAL_CHARS = 10_000
# domain: its types, and the file-name template of each type
DOMAINS = {
    "classification_societies": {
        "class_rules": "{org}_{title_short}_{report_id}_{year}",
        "class_guidance": "{org}_{report_id}_{title_short}_{year}",
        "class_certificate": "{org}_{vessel}_{title_short}_{date}",
        "class_notation": "{org}_{title_short}_{year}",
    },
    "naval_architecture": {
        "stability_analysis": "{org}_{vessel}_{title_short}_{date}",
        "structural_analysis": "{org}_{author_last}_{title_short}_{year}",
        "hydrodynamic_analysis": "{org}_{title_short}_{report_id}_{year}",
        "lines_plan": "{org}_{vessel}_{title_short}_{report_id}",
        "general_arrangement": "{org}_{vessel}_{title_short}_{report_id}_{year}",
    },
    "marine_operations": {
        "voyage_plan": "{org}_{vessel}_{title_short}_{date}",
        "cargo_plan": "{org}_{vessel}_{title_short}_{date}",
        "ballast_plan": "{org}_{vessel}_{title_short}_{year}",
        "survey_report": "{org}_{vessel}_{title_short}_{date}",
        "inspection_report": "{org}_{vessel}_{title_short}_{date}",
        "incident_report": "{org}_{title_short}_{date}",
        "procedure_sop": "{org}_{title_short}_{year}",
    },
    "offshore_subsea": {
        "pipeline_design": "{org}_{title_short}_{report_id}_{year}",
        "riser_analysis": "{org}_{title_short}_{report_id}_{year}",
        "mooring_analysis": "{org}_{title_short}_{report_id}_{year}",
        "fea_report": "{org}_{title_short}_{report_id}_{year}",
        "cfd_report": "{org}_{title_short}_{report_id}_{year}",
        "installation_report": "{org}_{title_short}_{report_id}_{year}",
        "feed_study": "{org}_{title_short}_{year}",
    },
    "equipment": {
        "engine_manual": "{org}_{equipment}_{title_short}_{year}",
        "equipment_manual": "{org}_{equipment}_{title_short}_{year}",
        "navigation_manual": "{org}_{equipment}_{title_short}_{year}",
        "electrical_manual": "{org}_{title_short}_{year}",
    },
    "regulatory": {
        "imo_document": "{org}_{title_short}_{report_id}_{year}",
        "flag_state_document": "{org}_{title_short}_{report_id}_{year}",
        "port_state_document": "{org}_{title_short}_{year}",
        "ism_isps": "{org}_{title_short}_{year}",
    },
    "research": {
        "research_paper": "{author_last}_{title_short}_{year}",
        "thesis": "{author_last}_{title_short}_{org}_{year}",
        "conference_paper": "{author_last}_{title_short}_{org}_{year}",
    },
    "commercial": {
        "contract": "{org}_{title_short}_{date}",
        "invoice": "{org}_{report_id}_{date}",
        "proposal": "{org}_{title_short}_{date}",
        "correspondence": "{org}_{author_last}_{title_short}_{date}",
        "meeting_minutes": "{org}_{title_short}_{date}",
    },
    "general": {
        "technical_report": "{org}_{author_last}_{title_short}_{year}",
        "datasheet": "{org}_{title_short}_{report_id}",
        "specification": "{org}_{title_short}_{report_id}_{year}",
        "drawing": "{org}_{title_short}_{report_id}_{year}",
        "presentation": "{author_last}_{org}_{title_short}_{year}",
        "other": "{org}_{title_short}_{year}",
    },
}
DEFAULT_TEMPLATE, CONFIG_TEMPLATE = "{org}_{title_short}_{year}", "{type}_{org}_{title_short}_{year}"
GENERIC_FALLBACK, DOMAIN_FALLBACK = ("other", 0.1), ("other", 0.15)

# --- fixed values: names and folders -----------------------------------------------------------------------------------
NAME_LENGTH = 76
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
SEPARATORS = r"[\s\-–—_.,;:!@#$%^&*()\[\]{}]+"
BROAD_DOMAINS = {
    "academic": "certificate academic_transcript transcript marksheet degree diploma thesis research_paper conference_paper project_report",
    "employment": "offer_letter appointment_letter experience_letter internship contract agreement nda",
    "financial": "invoice receipt payslip tax bank_statement",
    "identity": "id_card license passport visa voter_id aadhar pan",
    "technical": "manual datasheet specification drawing diagram report technical_report",
    "correspondence": "letter correspondence meeting_minutes presentation",
}
FOLDER_STRATEGIES = ["year", "type", "year_type", "domain_type", "domain_year"]

# --- fixed values: routing, labels, responses, scans -------------------------------------------------------------------
STRATEGY_LABELS = {"vlm_only": "VLM", "vlm_plus_heuristic": "VLM+H", "text_heuristic": "Heur", "text_heuristic_fallback": "Heur*", "ocr_heuristic": "OCR", "ocr_heuristic_fallback": "OCR*", "metadata_only": "Meta", "fallback_pending": "Pend"}
RESPONSE_CONFIDENCE = {"title": 0.85, "author": 0.80, "organization": 0.80, "date": 0.85, "report_id": 0.90, "document_type": 0.80, "summary": 0.75, "vessel_name": 0.80, "equipment_name": 0.80}
RESPONSE_YEAR, RESPONSE_KEYWORD, PAGE_TWO_FACTOR = 0.85, 0.70, 0.90
OCR_FIXES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("•", "*")]
FILE_WORDS = "report|certificate|invoice|letter|agreement|contract|card|license|licence|offer|appointment|internship|project|analysis|simulation|resume|marks|list|slip|degree|completion|experience|training|course|exam"
FILLER_WORDS = ["new", "copy", "final", "draft", "english", "original", "untitled"]
AGREEMENT_BOOST, AGREEMENT_CAP = 0.10, 0.98
SIZE_BOUNDS = (1024, 2_147_483_648)


TYPE_DOMAIN = {t: d for d, types in DOMAINS.items() for t in types}
TEMPLATES = {t: template for types in DOMAINS.values() for t, template in types.items()}
