"""Word lists, dictionaries, weights and bounds that results depend on.

They are data, passed to the operators as default arguments; every operator takes others.
"""

# --- tagging -------------------------------------------------------------------------------------------------------
TAG_KEYWORDS = {
    "xr": ["xr", "ar ", "vr ", "mixed reality", "spatial computing", "headset"],
    "robotics": ["robot", "robotics", "manipulator", "autonomous system"],
    "marine": ["marine", "ocean", "underwater", "sea", "deep-sea", "subsea"],
    "autonomy": ["autonomy", "autonomous", "navigation", "planning"],
    "perception": ["perception", "vision", "slam", "reconstruction", "tracking"],
    "teleoperation": ["teleoperation", "telepresence", "remote operation"],
    "mapping": ["mapping", "localization", "3d", "3-d", "point cloud"],
    "sensing": ["sensor", "sonar", "lidar", "depth", "imaging"],
    "hci": ["hci", "interaction", "user study", "interface"],
    "simulation": ["simulation", "digital twin", "simulator"],
}

# --- item score ----------------------------------------------------------------------------------------------------
RECENCY_POINTS = [(24, 32), (72, 24), (168, 14), (720, 6)]
RECENCY_OLD = 2
SOURCE_POINTS = {"ARXIV": 22, "GITHUB": 18, "YOUTUBE": 14, "RSS": 12, "WEBSITE": 10}
IMPORTANT_TAGS = ["xr", "marine", "robotics", "autonomy", "perception", "simulation", "mapping", "sensing"]
NOVELTY_WORDS = ["new", "novel", "introducing", "first", "benchmark", "real-time", "digital twin", "underwater", "telepresence", "3d reconstruction", "release", "open-source", "dataset"]
STAR_POINTS = [(5000, 12), (1000, 8), (250, 4)]

# --- first item score ----------------------------------------------------------------------------------------------
XR_KEYWORDS = ["vr", "ar", "xr", "hci", "interaction", "headset", "tracking", "hand tracking", "spatial", "slam", "pose", "telepresence"]
MARINE_KEYWORDS = ["auv", "rov", "underwater", "sonar", "acoustic", "marine", "ocean", "subsea", "bathymetry", "navigation", "localization"]
SOURCE_BOOST = {"RSS": 8.0, "ARXIV": 10.0}

# --- lab matching --------------------------------------------------------------------------------------------------
LAB_KEYWORDS = {
    "mbari": ["mbari", "monterey bay aquarium research institute", "monterey bay"],
    "whoi-dsl": ["woods hole", "whoi", "deep submergence laboratory", "oceanographic institution"],
    "uw-apl-ocean": ["applied physics laboratory", "university of washington", "uw apl", "ocean engineering"],
    "ntnu-amos": ["ntnu", "amos", "centre for autonomous marine operations and systems", "autonomous marine operations"],
    "eth-asl": ["eth zürich", "eth zurich", "autonomous systems lab", "asl.ethz", "ethz"],
    "stanford-oceanic-robotics": ["stanford", "oceanic robotics", "stanford university"],
    "uw-reality-lab": ["reality lab", "university of washington", "uw reality lab"],
    "mit-media-lab": ["mit media lab", "media lab", "massachusetts institute of technology", "mit"],
    "tum-visual-computing": ["tum", "technical university of munich", "visual computing group"],
    "max-planck-perceiving-systems": ["max planck", "perceiving systems", "mpi", "max-planck institute"],
}

# --- enumerations --------------------------------------------------------------------------------------------------
SOURCE_TYPES = ["RSS", "ARXIV", "GITHUB", "YOUTUBE", "WEBSITE"]
SIGNAL_TYPES = ["DATASET", "REPOSITORY", "PAPER", "VIDEO", "SCHOLARSHIP", "INTERNSHIP", "PHD_POSITION", "GRANT", "EXPEDITION", "DISCOVERY", "REPORT", "EVENT", "LAB_UPDATE", "NEWS"]
#: Words that give a signal its type, in the order in which they are asked, and the source type that does so at once.
SIGNAL_TYPE_WORDS = [
    ("DATASET", None, ["dataset", "data set", "data repository", "zenodo", "figshare", "kaggle", "dataverse"]),
    ("REPOSITORY", "GITHUB", ["github.com", "repository", "source code"]),
    ("PAPER", "ARXIV", ["arxiv", "paper", "preprint"]),
    ("VIDEO", "YOUTUBE", ["youtube.com", "youtu.be", "video"]),
    ("SCHOLARSHIP", None, ["scholarship", "fellowship"]),
    ("INTERNSHIP", None, ["internship"]),
    ("PHD_POSITION", None, ["phd", "ph.d", "doctoral position"]),
    ("GRANT", None, ["grant", "funding opportunity"]),
    ("EXPEDITION", None, ["expedition", "field campaign", "cruise"]),
    ("DISCOVERY", None, ["discovery", "breakthrough"]),
    ("REPORT", None, ["report", "white paper", "whitepaper"]),
    ("EVENT", None, ["conference", "workshop", "webinar", "symposium", "event"]),
    ("LAB_UPDATE", None, ["lab update", "homepage"]),
]
DEFAULT_SIGNAL_TYPE = "NEWS"
#: Addresses of the sources of papers by name, and that of all others.
PAPER_SOURCE_URLS = {"arXiv XR/CV": "https://arxiv.org/search/?query=virtual+reality+augmented+reality+xr+spatial+computing&searchtype=all&source=header"}
PAPER_SOURCE_URL = "https://arxiv.org/list/cs.RO/recent"

# --- entity dictionaries: (type, canonical name, aliases) ----------------------------------------------------------
TECHNOLOGIES = [
    ("technology", "ROV", ["remotely operated vehicle", "remotely-operated vehicle"]),
    ("technology", "AUV", ["autonomous underwater vehicle", "autonomous underwater vehicles"]),
    ("technology", "SLAM", ["simultaneous localization and mapping"]),
    ("technology", "NeRF", ["neural radiance field", "neural radiance fields"]),
    ("technology", "Gaussian Splatting", ["gaussian splats", "3d gaussian splatting"]),
    ("technology", "Photogrammetry", ["photogrammetric"]),
    ("technology", "Bathymetry", ["bathymetric"]),
    ("technology", "LiDAR", ["lidar", "laser scanning"]),
    ("technology", "Side-Scan Sonar", ["side scan sonar", "sidescan sonar"]),
    ("technology", "Multibeam Sonar", ["multibeam", "multi-beam sonar"]),
    ("technology", "Spatial Computing", ["spatial-computing"]),
    ("technology", "VR", ["virtual reality"]),
    ("technology", "AR", ["augmented reality"]),
    ("technology", "Digital Twin", ["digital twins"]),
    ("technology", "Computer Vision", ["machine vision"]),
]
ORGANIZATIONS = [
    ("organization", "NOAA", ["national oceanic and atmospheric administration"]),
    ("organization", "NOAA Ocean Exploration", ["NOAA OE", "ocean exploration"]),
    ("organization", "UNESCO", ["united nations educational scientific and cultural organization"]),
    ("organization", "UNESCO Underwater Cultural Heritage", ["underwater cultural heritage", "UNESCO UCH"]),
    ("institution", "Woods Hole Oceanographic Institution", ["WHOI"]),
    ("lab", "Monterey Bay Aquarium Research Institute", ["MBARI"]),
    ("organization", "Ocean Exploration Trust", ["OET"]),
    ("organization", "Schmidt Ocean Institute", ["SOI"]),
    ("institution", "Texas A&M University", ["TAMU"]),
    ("organization", "Institute of Nautical Archaeology", ["INA"]),
    ("institution", "Flinders University", []),
    ("organization", "Maritime Archaeology Trust", []),
    ("organization", "CyArk", []),
    ("organization", "OpenHeritage3D", ["open heritage 3d"]),
    ("institution", "Harvard Dataverse", []),
    ("organization", "Zenodo", []),
    ("organization", "Figshare", []),
    ("organization", "PANGAEA", ["pangaea data publisher"]),
]
PROJECTS = [
    ("project", "Ocean Exploration Cooperative Institute", ["OECI"]),
    ("project", "OpenHeritage3D", ["open heritage 3d"]),
    ("project", "MB-System", ["mb system"]),
    ("expedition", "Nautilus Live", ["nautiluslive"]),
    ("expedition", "Beyond the Blue", ["beyond blue"]),
]
SITES = [
    ("archaeological_site", "Antikythera Shipwreck", ["Antikythera wreck"]),
    ("archaeological_site", "Black Sea Shipwrecks", ["black sea maritime archaeology project", "Black Sea MAP"]),
    ("archaeological_site", "Burgzand Noord", ["BZN"]),
]
VESSELS = [
    ("vessel", "E/V Nautilus", ["Nautilus", "EV Nautilus", "exploration vessel Nautilus"]),
    ("vessel", "R/V Falkor (too)", ["Falkor (too)", "Falkor too", "RV Falkor too", "research vessel Falkor too"]),
    ("vessel", "NOAA Ship Okeanos Explorer", ["Okeanos Explorer", "R/V Okeanos Explorer", "RV Okeanos Explorer"]),
    ("vessel", "R/V Atlantis", ["Atlantis", "RV Atlantis", "research vessel Atlantis"]),
]
KNOWN_RESEARCHERS = [("researcher", "Robert Ballard", ["Bob Ballard"]), ("researcher", "James Delgado", ["Jim Delgado"])]
RESEARCHER_FIELDS = ["author", "authors", "creator", "creators", "contributor", "contributors", "researcher", "researchers"]

# --- record linkage ------------------------------------------------------------------------------------------------
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
IDENTIFIER_FIELDS = {
    "doi": "doi",
    "persistentid": "persistentId", "persistent_id": "persistentId",
    "externalid": "externalId", "external_id": "externalId",
    "globalid": "globalId", "global_id": "globalId",
    "datasetid": "datasetId", "dataset_id": "datasetId",
    "repositoryid": "repositoryId", "repository_id": "repositoryId",
}
TITLE_THRESHOLD = 0.92
DUPLICATE_REASONS = {
    "identifier": "Identifier metadata matched exactly.",
    "url": "Canonical URL matched after normalization.",
    "title": "Title matched exactly after normalization.",
    "title_high": "Title similarity met the high-confidence threshold.",
    "none": "No deterministic duplicate match found.",
}
PROCESSING_REASONS = {
    "identifier": "Exact identifier match found.",
    "url": "Canonical URL matched an existing signal.",
    "title": "Normalized title matched exactly.",
    "title_high": "Title similarity exceeded 0.92.",
    "none": "No duplicate candidate matched.",
}

# --- relevance -----------------------------------------------------------------------------------------------------
DIMENSIONS = ["researchRelevance", "novelty", "technologyImpact", "portfolioUsefulness", "graduateValue", "communityAttention"]
WEIGHTS = {"researchRelevance": 0.30, "novelty": 0.20, "technologyImpact": 0.20, "portfolioUsefulness": 0.15, "graduateValue": 0.10, "communityAttention": 0.05}
BANDS = [(75, "HIGH"), (50, "MEDIUM"), (25, "LOW"), (0, "IGNORE")]
SCORING_VERSION = "1.0.0"
DOMAIN_ALIASES = {
    "marineArchaeology": ["marine archaeology", "maritime archaeology", "nautical archaeology", "underwater archaeology", "underwater cultural heritage", "submerged cultural heritage", "shipwreck", "wreck site"],
    "underwaterRobotics": ["underwater robotics", "marine robotics", "autonomous underwater vehicle", "remotely operated vehicle", "auv", "rov", "subsea robot", "underwater robot"],
    "xrHci": ["xr", "extended reality", "virtual reality", "augmented reality", "mixed reality", "spatial computing", "human computer interaction", "hci"],
    "digitalHeritage": ["digital heritage", "cultural heritage", "heritage visualization", "digital preservation", "virtual museum"],
    "oceanMapping": ["ocean mapping", "seafloor mapping", "bathymetry", "bathymetric", "sonar mapping", "multibeam", "side scan sonar"],
    "conservation": ["conservation", "preservation", "site monitoring", "cultural resource management"],
}
#: What each rule says of a signal: fixed texts.
RULE_DESCRIPTIONS = {
    "research.domain.marine-archaeology": "Signal matches the marine archaeology domain.",
    "research.domain.underwater-robotics": "Signal matches underwater robotics or marine autonomy.",
    "research.domain.digital-heritage": "Signal connects to digital heritage or cultural preservation.",
    "research.domain.ocean-mapping": "Signal aligns with ocean mapping or seafloor documentation.",
    "research.context.archaeological-site": "Signal references a vessel, shipwreck, or archaeological site in target context.",
    "research.combination.xr-hci-marine-heritage": "XR or HCI is connected to marine or heritage context.",
    "research.combination.underwater-robotics-method": "Underwater robotics signal includes concrete priority methods or sensors.",
    "research.combination.mapping-reconstruction-context": "Mapping or reconstruction technology is applied to marine or heritage work.",
    "research.opportunity.aligned": "Opportunity is aligned with a target research domain.",
    "research.domain.diversity": "Signal spans multiple target domains.",
    "novelty.recency.thirty-days": "Signal was published within the recent scoring window.",
    "novelty.recency.six-months": "Signal was published within six months of ingestion.",
    "novelty.language.observable": "Observable novelty language is present.",
    "novelty.artifact.dataset": "Signal includes or releases a dataset.",
    "novelty.artifact.repository": "Signal includes or releases a repository.",
    "novelty.combination.emerging-technical-context": "Signal combines multiple relevant technologies in a target context.",
    "novelty.event.discovery-expedition": "Signal reports a discovery or expedition update.",
    "technology.priority.matches": "Signal uses priority technologies.",
    "technology.enables.target-workflows": "Technology supports mapping, reconstruction, autonomy, interaction, preservation, or access.",
    "technology.artifacts.reusable": "Signal includes reusable technical artifacts or identifiers.",
    "technology.combination.cross-domain": "Signal combines multiple relevant technologies.",
    "portfolio.artifact.repository": "Public repository is available.",
    "portfolio.artifact.dataset": "Public dataset or reconstruction data is available.",
    "portfolio.artifact.reusable-code": "Reusable code or reproducible method is visible.",
    "portfolio.scope.prototype-friendly": "Signal suggests a manageable prototype or visualization direction.",
    "portfolio.alignment.student-project": "Relevant technology and domain context could support a student project.",
    "graduate.people.researchers": "Named researchers are available for follow-up.",
    "graduate.people.lab-institution": "Named lab, institution, or organization is available.",
    "graduate.context.project-expedition": "Named project or expedition provides research context.",
    "graduate.opportunity.formal": "Signal is a formal graduate, funding, internship, or event opportunity.",
    "graduate.opportunity.language": "Opportunity or academic-path language is present.",
    "graduate.alignment.research-direction": "Domains and technologies align with the target research direction.",
    "community.metric.citations": "Citation evidence is available.",
    "community.metric.github": "GitHub stars or forks show community attention.",
    "community.metric.video-views": "Video view evidence is available.",
    "community.metric.social": "Social engagement evidence is available.",
    "community.metric.multiple-sources": "Multiple sources cover the same signal.",
    "community.source.authoritative": "Authoritative source metadata is present.",
}
NOVELTY_LANGUAGE = ["first", "novel", "new", "newly", "newly discovered", "newly mapped", "recently released", "release", "released", "benchmark", "discovery", "expedition update"]
DATASET_LANGUAGE = ["dataset", "data set", "benchmark", "records", "point cloud", "3d model", "reconstruction data"]
REPOSITORY_LANGUAGE = ["github", "gitlab", "source code", "open source", "open-source", "repository", "code release"]
OPPORTUNITY_TYPES = ["GRANT", "SCHOLARSHIP", "INTERNSHIP", "PHD_POSITION", "EVENT"]
PAPER_TYPES = ["PAPER", "REPORT"]
AUTHORITY_PHRASES = ["arxiv", "ieee", "acm", "springer", "elsevier", "nature", "science", "unesco", "noaa", "whoi", "mbari", "zenodo", "figshare", "pangaea", "openheritage3d"]
MAPPING_TECHNOLOGIES = ["Photogrammetry", "SLAM", "NeRF", "Gaussian Splatting", "Side-Scan Sonar", "Multibeam Sonar", "Bathymetry", "Computer Vision", "Digital Twin"]
ENABLING_CONTEXTS = ["mapping", "reconstruction", "documentation", "autonomy", "interaction", "preservation", "access", "visualization", "simulation"]
BUILDABLE_CONTEXTS = ["unity", "unreal", "web visualization", "dashboard", "xr", "virtual reality", "augmented reality", "simulation", "prototype", "computer vision", "robotics", "mapping", "3d model"]
OPPORTUNITY_LANGUAGE = ["call for papers", "conference", "scholarship", "assistantship", "internship", "grant", "phd", "doctoral", "graduate", "fellowship"]

# --- embeddings, search and assessment -----------------------------------------------------------------------------
EMBEDDING_INPUT_VERSION = "1.1.0"
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.65, 0.35
STOP_WORDS = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
PROMPT_VERSION = "1.0.0"
