"""Word lists, names and patterns that results depend on, as the data's conventions have them."""

# Words that carry no meaning in searches and similarities.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each which she do how their if up out many "
    "then them these so some her would make like into him time two more go no way could my than first been call who also any new where much just after very well here should still"
).split()

# Verbs of action in recommendations.
ACTION_VERBS = (
    "establish implement develop create improve enhance strengthen expand increase reduce review assess evaluate consider adopt introduce maintain monitor "
    "provide support enable facilitate promote encourage prioritise prioritize address tackle resolve prevent ensure commission consult update clarify publish "
    "engage deliver conduct undertake initiate collaborate coordinate oversee regulate enforce mandate allocate fund resource train educate inform report audit "
    "inspect investigate examine reform revise amend streamline simplify standardise standardize integrate consolidate extend limit restrict remove set "
    "define specify determine approve authorise authorize build design plan prepare bring make take meet come form work learn drive produce require"
).split()

# Patterns of bodies that recommendations are addressed to, in the order in which they are tried.
ENTITIES = [
    r"NHS\s+England", r"NHS\s+Improvement", r"HSSIB", r"HSIB", r"(?:the\s+)?(?:Home\s+Office|Cabinet\s+Office|Treasury)",
    r"(?:the\s+)?(?:Department|Ministry)\s+(?:of|for)\s+[\w\s]+", r"(?:the\s+)?(?:Secretary|Minister)\s+of\s+State",
    r"(?:the\s+)?CQC|Care\s+Quality\s+Commission", r"(?:the\s+)?IOPC", r"(?:the\s+)?College\s+of\s+Policing", r"(?:the\s+)?(?:ICS|ICB)s?",
    r"(?:the\s+)?(?:Trust|Provider|Board)s?", r"(?:the\s+)?Government", r"(?:the\s+)?(?:Review|Committee|Panel|Commission|Inquiry)",
    r"(?:All|Every)\s+(?:providers?|commissioners?|trusts?|boards?)", r"Every\s+(?:provider\s+)?board", r"(?:Professional\s+)?bodies",
    r"(?:Local\s+)?(?:authorities|councils)", r"DHSC", r"NIHR", r"Regulators?", r"Inpatient\s+staff", r"Government\s+ministers?",
    r"Clinical\s+Commissioning\s+Groups?", r"CCGs?", r"TEWV", r"Middlesbrough\s+Council", r"(?:the\s+)?Shelford\s+Group", r"NICE",
    r"Royal\s+College(?:s)?\s+(?:of\s+)?(?:Psychiatrists?|Nursing)?",
]

# Groups of words that stand for one another in searches, by their head word.
SYNONYMS = {
    "recommend": ["recommend", "suggestion", "suggest", "advise", "propose", "urge", "advocate", "endorse", "recommendation", "recommendations"],
    "suggest": ["suggest", "recommend", "proposal", "propose", "advise", "hint", "indicate", "suggestion", "suggestions"],
    "respond": ["respond", "response", "reply", "answer", "feedback", "reaction", "comment", "responses", "replies"],
    "response": ["response", "respond", "reply", "answer", "feedback", "reaction", "comment", "responses", "replies"],
    "implement": ["implement", "execute", "carry out", "put into practice", "apply", "deploy", "implementation"],
    "review": ["review", "examine", "assess", "evaluate", "analyze", "inspect", "analysis"],
    "policy": ["policy", "procedure", "guideline", "protocol", "framework", "strategy", "policies"],
    "accept": ["accept", "agree", "approve", "endorse", "support", "adopt", "acceptance"],
    "reject": ["reject", "decline", "refuse", "dismiss", "deny", "oppose", "rejection"],
    "government": ["government", "department", "ministry", "agency", "authority", "administration"],
    "report": ["report", "document", "paper", "study", "analysis", "investigation"],
    "committee": ["committee", "panel", "board", "commission", "group", "team"],
    "budget": ["budget", "funding", "financial", "cost", "expenditure", "allocation"],
    "urgent": ["urgent", "immediate", "critical", "priority", "emergency", "pressing"],
}

# Words whose overlap raises the similarity of a recommendation and a response.
GOVERNMENT_TERMS = "government recommendation accept support implement policy department nhs england health care provider commissioner trust board cqc".split()

# Phrases of an official reply.
REPLY_PHRASES = [
    "government response", "the government supports", "the government accepts", "the government agrees", "the government notes", "the government rejects",
    "we accept", "we support", "we agree", "we welcome", "accept the recommendation", "support the recommendation", "accept this recommendation", "nhs england has",
    "nhs england will", "nhs england is", "care quality commission", "nice is", "we have convened", "we are happy to confirm",
]

# Openings of a reply, in the order in which they are looked for.
REPLY_OPENINGS = [
    "government response to recommendation", "the government supports", "the government accepts", "the government agrees", "the government notes", "the government rejects",
]

# The status of a response: rules in order, each with the status, its confidence and its patterns.
STATUS_RULES = [
    ("Rejected", 0.9, [
        r"\breject(?:s|ed)?\s+(?:this\s+|the\s+)?recommendation", r"\bdoes?\s+not\s+accept\s+(?:this\s+|the\s+)?recommendation",
        r"\bcannot\s+accept\s+(?:this\s+|the\s+)?recommendation", r"\bwill\s+not\s+(?:be\s+)?implement(?:ing)?\s+(?:this\s+|the\s+)?recommendation",
        r"\bdisagree(?:s|d)?\s+with\s+(?:this\s+|the\s+)?recommendation",
    ]),
    ("Partial", 0.85, [
        r"\baccept(?:s|ed)?\s+(?:this\s+|the\s+)?(?:recommendation\s+)?in\s+(?:part|principle)", r"\bpartially\s+accept",
        r"\bsupport(?:s|ed)?\s+(?:this\s+|the\s+)?(?:recommendation\s+)?in\s+principle", r"\bin\s+principle[,.]?\s+(?:we\s+)?(?:support|accept|agree)",
        r"\bbroadly\s+support(?:s|ed)?(?!\s+(?:the|this)\s+recommendation)", r"\baccept(?:s|ed)?\s+(?:the\s+)?(?:intent|spirit)", r"\bunder\s+consideration",
        r"\bwill\s+consider\s+(?:the\s+|this\s+)?(?:recommendation|proposal|request)", r"\brequires?\s+further\s+consideration",
    ]),
    ("Accepted", 0.9, [
        r"\baccept(?:s|ed)?\s+(?:this\s+|the\s+)?recommendation", r"\bsupport(?:s|ed)?\s+(?:this\s+|the\s+)?recommendation",
        r"\bagree(?:s|d)?\s+(?:with\s+)?(?:this\s+|the\s+)?recommendation", r"\bwelcome(?:s|d)?\s+(?:this\s+|the\s+)?recommendation",
        r"\bthe\s+government\s+support(?:s|ed)?\b", r"\bthe\s+government\s+accept(?:s|ed)?\b", r"\bwill\s+implement\b", r"\bfully\s+accept", r"\bhas\s+(?:begun|started|commenced)",
    ]),
    ("Accepted", 0.8, [
        r"\bcommitted\s+to\s+(?:working|improving|delivering|ensuring)", r"\bconvened\s+(?:a\s+)?(?:working|expert)\s+group", r"\bwe\s+have\s+convened",
        r"\bintends?\s+to\s+(?:provide|publish|deliver|implement)", r"\bwill\s+(?:provide|publish|deliver|work\s+with)", r"\bhas\s+begun\s+work",
        r"\bwe\s+(?:are|have)\s+(?:developing|establishing|reviewing|currently)", r"\bnhs\s+england\s+has\s+(?:begun|written|started)", r"\bwe\s+are\s+happy\s+to\s+confirm",
    ]),
    ("Noted", 0.75, [r"\bnote(?:s|d)?\s+(?:this\s+|the\s+)?recommendation", r"\backnowledge(?:s|d)?\s+(?:this\s+|the\s+)?recommendation"]),
    ("Accepted", 0.6, [r"support", r"accept", r"welcome", r"agree", r"committed", r"happy to confirm"]),
]
# Between the second and the third rule: a refusal of means, softened, is partial with 0.8.
REFUSED_MEANS = [r"\bdo(?:es)?\s+not\s+support\s+(?:mandating|requiring|prescribing)\b", r"\bwill\s+not\s+(?:be\s+)?mandat(?:ing|e)\b", r"\bcannot\s+(?:mandate|require|prescribe)\b"]
SOFTENED = r"\b(?:recognis|support|expect|however|important)"

# Themes of a sentence, in order, by words it holds.
THEMES = [
    ("Implementation", ["implementation", "deploy", "roll out", "deliver"]), ("Monitoring", ["monitor", "measure", "evaluate", "review"]),
    ("Workforce", ["training", "education", "workforce"]), ("Technology", ["technology", "digital", "data", "system"]),
    ("Policy", ["policy", "framework", "guideline"]), ("Financial", ["financial", "budget", "cost"]),
]

# Types of a document, in order, by words it holds.
DOCUMENT_TYPES = [
    ("government", r"\b(?:ministry|department|government|parliament|cabinet|policy|regulation|act|bill|statute|recommendation|directive|circular|guidance|official|public|crown|her majesty)\b"),
    ("healthcare", r"\b(?:patient|medical|health|clinical|hospital|treatment|diagnosis|therapy|medication|nhs|healthcare|blood|infection)\b"),
    ("legal", r"\b(?:court|judge|legal|law|litigation|evidence|testimony|witness|ruling|case|proceeding|hearing|trial)\b"),
]

# Organisations by phrases, in order, and their keys.
ORGANISATIONS = [
    ("nihr", ["national institute for health and care research", "nihr"]), ("dhsc", ["department of health and social care", "dhsc"]), ("nhs_england", ["nhs england"]),
    ("cqc", ["care quality commission", "cqc"]), ("nice", ["national institute for health and care excellence", "nice"]), ("royal_college", ["royal college"]),
    ("shelford_group", ["the shelford group", "shelford group"]), ("tewv", ["tewv", "tees, esk and wear"]), ("middlesbrough_council", ["middlesbrough council"]),
    ("south_tees", ["south tees"]), ("provider_collaborative", ["provider collaborative"]),
]

# Organisations that a recommendation directs to act, in order.
DIRECTED = [
    (r"\bTEWV\s+(?:must|should|needs?\s+to)", "tewv"),
    (r"\bTees,?\s+Esk\s+and\s+Wear\s+Valleys?\s+(?:NHS\s+)?(?:Foundation\s+)?Trust\s+(?:must|should)", "tewv"),
    (r"\bNHS\s+England\s+(?:must|should|needs?\s+to|and\s+provider|works)", "nhs_england"),
    (r"\bMiddlesbrough\s+Council\s+(?:must|should|needs?\s+to|and\s+Health)", "middlesbrough_council"),
    (r"\bSouth\s+Tees\s+Safeguarding\s+Children", "south_tees"),
    (r"\bCare\s+Quality\s+Commission\s+(?:must|should|evaluates)", "cqc"),
    (r"\bNICE\s+(?:must|should|evaluates)", "nice"),
    (r"\bNational\s+Institute\s+for\s+Health\s+and\s+Care\s+Excellence\s+(?:must|should|evaluates)", "nice"),
    (r"\bRoyal\s+College\s+(?:of\s+Psychiatrists\s+)?(?:must|should|forms)", "royal_college"),
    (r"\bDHSC\s+(?:must|should)", "dhsc"),
    (r"\bprovider\s+collaborative[s]?\s+(?:must|should)", "provider_collaborative"),
]

# Openings of sentences that recommend.
RECOMMENDING = [
    r"nhs\s+england\s+should", r"providers?\s+should", r"trusts?\s+should", r"boards?\s+should", r"icss?\s+should", r"ics\s+and\s+provider", r"cqc\s+should", r"dhsc\s+should",
    r"dhsc,?\s+in\s+partnership", r"every\s+provider", r"all\s+providers?\s+should", r"provider\s+boards?\s+should", r"this\s+multi-professional\s+alliance\s+should",
    r"the\s+review\s+should", r"commissioners?\s+should", r"regulators?\s+should", r"recommendation\s+\d+\s+[a-z]", r"we\s+recommend", r"hsib\s+recommends", r"hssib\s+recommends",
    r"it\s+should\s+also", r"they\s+should", r"this\s+forum\s+should", r"this\s+programme\s+should", r"these\s+systems\s+should", r"the\s+digital\s+platforms",
    r"the\s+output\s+of\s+the", r"including,?\s+where\s+appropriate", r"to\s+facilitate\s+this",
]

# Openings of sentences that respond.
RESPONDING = [
    r"government\s+response", r"the\s+government\s+supports?", r"the\s+government\s+accepts?", r"the\s+government\s+agrees?", r"the\s+government\s+notes?", r"the\s+government\s+rejects?",
    r"the\s+government\s+recognises?", r"the\s+government\s+is\s+committed", r"the\s+government\s+will", r"we\s+support", r"we\s+accept", r"we\s+agree", r"we\s+welcome",
    r"we\s+are\s+happy\s+to\s+confirm", r"dhsc\s+and\s+nhs\s+england\s+support", r"nhs\s+england\s+(?:has|will|is)", r"care\s+quality\s+commission\s+(?:is|has|will)",
    r"the\s+national\s+institute\s+for\s+health", r"nice\s+(?:is|has|will)",
]

# Sentences about recommendations rather than making one.
META = [
    r"^the\s+recommendations?\s+(?:have|has|are|were|will|can|may|should|from)", r"^these\s+recommendations?\s+(?:will|can|should|may|have|are)",
    r"^(?:our|their|its|his|her)\s+recommendations?", r"recommendations?\s+(?:from|of|in)\s+(?:this|the)\s+(?:review|report)",
    r"(?:implement|implementing|implemented)\s+(?:these|the|all|our)?\s*recommendations?", r"once\s+implemented.*recommendations?", r"recommendations?\s+(?:will|can|should)\s+help",
    r"i\s+(?:truly\s+)?believe.*recommendations?", r"i\s+hope.*recommendations?", r"^our\s+objectives\s+were\s+to", r"^we\s+(?:were|are)\s+(?:told|informed|advised)",
    r"^when\s+we\s+(?:first\s+)?established", r"^we\s+found\s+that", r"^they\s+proposed\s+practical", r"^this\s+document\s+outlines", r"^the\s+insights\s+below",
    r"^the\s+goal\s+is\s+to\s+provide", r"^we\s+have\s+made\s+\d+\s+recommendations", r"^this\s+report\s+(?:also\s+)?makes\s+recommendations", r"^we\s+recognise\s+that\s+care",
]

# What ends a numbered recommendation besides the next one.
HARD_STOPS = [
    r"\bWhy'?s?\s+diagram\b", r"\bFigure\s+\d+[:\s]", r"\bTable\s+\d+[:\s]", r"(?:to|\.)\s*While\s+(?:national|there\s+is)", r"(?:to|\.)\s*Current\s+research\s+only",
    r"\b\d+\.\d+\.\d+\s+(?:The|A|In|Staff|Subject|Mental|While|Current)", r"\b\d+\.\d+\s+(?:What|The|How|Why|Where|When|Impact|Capability|Awareness)",
    r"(?<=[.!?])\s+While\s+national\s+guidance", r"(?<=[.!?])\s+Current\s+research\s+only", r"(?<=[.!?])\s+The\s+investigation\s+(?:was|visited|observed|found|'s)",
    r"(?<=[.!?])\s+Staff\s+(?:told|said|reported|also)", r"(?<=[.!?])\s+Subject\s+matter\s+advisors", r"(?<=[.!?])\s+Mental\s+health\s+practitioners\s+told",
    r"\bHSSIB\s+proposes\s+the\s+following\b", r"(?<=[.!?])\s+In\s+the\s+following\s+sections", r"(?<=[.!?])\s+New\s+builds\s+and", r"(?<=[.!?])\s+Infrastructure\s*[-–]",
    r"(?<=[.!?])\s+In\s+some\s+locations", r"(?<=[.!?])\s+Inequalities\s+continued", r"(?<=[.!?])\s+Some\s+organisational\s+cultures", r"(?<=[.!?])\s+Availability\s+and\s+access",
    r"\bBuilt\s+mental\s+health\s+inpatient\s+environments\b", r"\bSocial\s+and\s+organisational\s+factors\b", r"(?<=[.!?])\s+This\s+reduced\s+continuity", r"\bHSSIB\s+makes\s+the\s+following\b",
]
SECTION_MARKS = [
    r"\bAppendix(?:es)?(?:\s+[A-Z0-9]+)?\b", r"\bGlossary\b", r"\bReferences\b", r"\bEndnotes?\b", r"\bAcknowledgements?\b", r"\bBibliography\b", r"\bFurther\s+(?:reading|information)\b",
    r"\bAbout\s+(?:this|the)\s+(?:report|review|investigation|document)\b", r"©\s*(?:Crown\s+)?[Cc]opyright", r"\bAll\s+content\s+is\s+available\s+under\b", r"\bISBN\b",
    r"\bSafety\s+[Oo]bservation(?:s)?(?:\s+[A-Z0-9/]+)?[:\s]", r"\bLocal-level\s+learning\b", r"\bBackground\s+and\s+context\b", r"\bFindings\s+and\s+analysis\b",
    r"\bSummary\s+of\s+(?:findings|recommendations)\b", r"\bThe\s+investigation\s+(?:found|makes|identified)\b", r"\bHSSIB\s+makes\s+the\s+following\s+safety\s+observation\b",
    r"\bSafety\s+observation\s+[A-Z]/\d{4}/\d{3}\b", r"\bProposed\s+(?:ICB|safety)\s+(?:response|action)\b", r"(?<=[.!?])\s+\d+\.\d+\.\d+\s+[A-Z]", r"(?<=[.!?])\s+\d+\.\d+\s+[A-Z][a-z]",
    r"\bLessons\s+(?:learned|learnt)\b", r"\bGood\s+practice\b", r"\bAreas?\s+(?:of|for)\s+(?:good\s+practice|improvement)\b",
    r"(?<=[.!?])\s+\d+\.?\s+[A-Z][a-z]+(?:\s+[a-z]+){0,3}(?=\s)",
]
HEADINGS = [
    r"Our\s+vision\s+for\s+(?:a\s+)?(?:better\s+)?future\b", r"Key\s+facts\b", r"Methodology\b", r"Findings\b(?!\s+and\s+analysis)", r"Case\s+studies\b", r"Measuring\s+what\s+matters\b",
    r"What\s+a\s+better\s+system\s+would\s+look\s+like\b", r"Principles\s+for\s+the\s+collection\b", r"The\s+safety\s+issues\s+framework\b", r"Data\s+on\s+deaths\b", r"Poor\s+safety\s+outcomes\b",
    r"Conclusion(?:s)?(?:\s+and\s+next\s+steps)?\b", r"This\s+section\s+(?:considers|explores|examines|discusses|looks\s+at)\b", r"The\s+investigation(?:'s)?\s+(?:found|visited|observed|focus)\b",
    r"(?:Staff|Interviewees|Those\s+interviewed)\s+(?:told|said|reported)\b", r"Hospital\s+environment\b", r"The\s+reference\s+investigation\b",
    r"New\s+builds\s+and\s+the\s+New\s+Hospital\s+Programme\b", r"Infrastructure\s+-\s+digital\b", r"Awareness\s+of\s+women'?s?\s+health\b", r"Capability\s+to\s+provide\b",
    r"The\s+first\s+episode\s+of\s+psychosis\s+pathway\b", r"Mental\s+health\s+practitioners\s+told\b", r"HSSIB\s+proposes\s+the\s+following\s+safety\b", r"Impact\s+of\s+built\s+environments\b",
]
INLINE_HEADING = r"\bRecommendation\s+\d{1,2}(?:\s+\d)?[:\s]+(?:All|The|NHS|Every|Provider|Trust|Board|ICS|CQC|DHSC|Ward|More|Professional|Except|TEWV|Middlesbrough)"

# Marks that an extractor leaves in texts.
ARTIFACTS = [r"\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?", r"GOV\.UK", r"https?://www\.gov\.uk", r"https?://www\.england\.nhs\.uk", r"\d+/\d+\s*$"]
ORG_LINE = r"The\s+Shelford\s+Group|NHS\s+England|Department\s+of\s+Health\s+and\s+Social\s+Care|DHSC|Care\s+Quality\s+Commission|National\s+Institute\s+for\s+Health\s+and\s+Care\s+Excellence|NICE|Royal\s+College[^\n]*"
ORG_NAMES = r"\b(NHS\s+England|Care\s+Quality\s+Commission|National\s+Institute\s+for\s+Health\s+and\s+Care\s+Excellence|Royal\s+College\s+of\s+Psychiatrists)\b"
CONCEPT_STOPS = "the a an and or but in on at to for of with".split()

# Terms of official reports that are marked in texts.
OFFICIAL_TERMS = [
    "recommend", "recommendation", "recommendations", "suggest", "advise", "propose", "accept", "reject", "agree", "disagree", "implement", "implementation", "consider", "approved", "declined",
    "response", "reply", "answer", "policy", "framework", "guideline", "protocol", "strategy", "committee", "department", "ministry", "government", "authority", "urgent", "immediate", "critical",
    "priority", "essential", "budget", "funding", "financial", "cost", "expenditure", "review", "analysis", "assessment", "evaluation", "inquiry",
]

# What a heading of a section without recommendations holds.
BOUNDARY_WORDS = [
    "observation", "appendix", "reference", "endnote", "acknowledgement", "glossary", "background", "context", "methodology", "finding", "conclusion", "summary",
]

# Where the wording of a recommendation begins, in this order, and the header that comes before it.
WORDING_STARTS = [
    r"(?i)\bThat\s+(?:the\s+)?(?:NHS|CQC|Care|Department|Trust|Government|DHSC|NIHR)",
    r"(?:NHS\s+England|CQC|Department|Trust|Government|DHSC)\s+(?:should|must|requires?)",
]
WORDING_HEADER = r"^(?:Safety\s+)?[Rr]ecommendation\s+(?:R/)?[\d/]+[:\s]+"

# Names of ways of detection by the opening of a recommendation, in this order, with the part of it that they take up.
OPENING_METHODS = [
    (r"^safety\s+recommendation\s+r/\d{4}/\d{3}", r"r/\d{4}/\d{3}", "hsib_recommendation_"),
    (r"^recommendation\s+\d{4}/\d{3}", r"\d{4}/\d{3}", "hsib_recommendation_"),
    (r"^recommendation\s+\d{1,2}\b", r"\d{1,2}", "numbered_recommendation_"),
    (r"^that\s+(?:the\s+)?(?:nhs|cqc|care|department|trust|government)", "", "that_entity"),
    (r"(?:nhs|cqc|trust|department|government)\s+(?:england\s+)?should", "", "entity_should"),
    (r"we recommend", "", "we_recommend"),
    (r"\b(should|must|shall)\s+\w+", "", "modal_verb"),
]

# Parts of the names of files that hold responses.
RESPONSE_FILES = ["response", "reply", "answer"]
