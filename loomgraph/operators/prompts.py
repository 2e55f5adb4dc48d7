"""Prompts for nodes: a table of wordings per data set, and task prompts that replace them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names by id, for data sets whose classes are known beforehand.
CLASSES = {
    "cora": ["Case Based", "Genetic Algorithms", "Neural Networks", "Probabilistic Methods", "Reinforcement Learning", "Rule Learning", "Theory"],
    "pubmed": ["Experimentally induced diabetes", "Diabetes Mellitus Type1", "Diabetes Mellitus Type2"],
    "arxiv": ["Numerical Analysis", "Multimedia", "Logic in Computer Science", "Computers and Society", "Cryptography and Security", "Distributed, Parallel, and Cluster Computing", "Human-Computer Interaction", "Computational Engineering, Finance, and Science", "Networking and Internet Architecture", "Computational Complexity", "Artificial Intelligence", "Multiagent Systems", "General Literature", "Neural and Evolutionary Computing", "Symbolic Computation", "Hardware Architecture", "Computer Vision and Pattern Recognition", "Graphics", "Emerging Technologies", "Systems and Control", "Computational Geometry", "Other Computer Science", "Programming Languages", "Software Engineering", "Machine Learning", "Sound", "Social and Information Networks", "Robotics", "Information Theory", "Performance", "Computation and Language", "Information Retrieval", "Mathematical Software", "Formal Languages and Automata Theory", "Data Structures and Algorithms", "Operating Systems", "Computer Science and Game Theory", "Databases", "Digital Libraries", "Discrete Mathematics"],
    "history": ["World", "Americas", "Asia", "Military", "Europe", "Russia", "Africa", "Ancient Civilizations", "Middle East", "Historical Study & Educational Resources", "Australia & Oceania", "Arctic & Antarctica"],
    "photo": ["Video Surveillance", "Accessories", "Binoculars & Scopes", "Video", "Lighting & Studio", "Bags & Cases", "Tripods & Monopods", "Flashes", "Digital Cameras", "Film Photography", "Lenses", "Underwater Photography"],
    "computer": ["Computer Accessories & Peripherals", "Tablet Accessories", "Laptop Accessories", "Computers & Tablets", "Computer Components", "Data Storage", "Networking Products", "Monitors", "Servers", "Tablet Replacement Parts"],
    "wikics": ["Computational linguistics", "Databases", "Operating systems", "Computer architecture", "Computer security", "Internet protocols", "Computer file systems", "Distributed computing architecture", "Web technology", "Programming language topics"],
    "instagram": ["Normal Users", "Commercial Users"],
    "cornell": ["student", "project", "course", "staff", "faculty"],
    "wisconsin": ["project", "faculty", "course", "student", "staff"],
    "washington": ["project", "course", "student", "faculty", "staff"],
    "texas": ["course", "project", "student", "faculty", "staff"],
    "reddit": ["Normal Users", "Popular Users"],
    "citeseer": ["Agents", "Machine Learning", "Information Retrieval", "Databases", "Human-Computer Interaction", "Artificial Intelligence"],
}
#: Classes as the prompt lists them, where they differ in wording or order.
LISTED = {
    "pubmed": ["Diabetes Mellitus Experimental", "Diabetes Mellitus Type1", "Diabetes Mellitus Type2"],
    "wisconsin": ["student", "project", "course", "staff", "faculty"],
    "washington": ["student", "project", "course", "staff", "faculty"],
    "texas": ["student", "project", "course", "staff", "faculty"],
}
#: Graph word, what a node is, and how the node's own text is given (title, abstract and text stand for columns).
WORDING = {
    "cora": ("graph", "a paper", "information: Title: {title}, Abstract: {abstract}."),
    "pubmed": ("graph", "a paper", "information: Title: {title}, Abstract: {abstract}."),
    "arxiv": ("citation graph", "a paper", "information: Title: {title}, Abstract: {abstract}."),
    "history": ("graph", "a history book", "information: {text}."),
    "photo": ("graph", "a product and its user review", "information: {text}."),
    "computer": ("graph", "a product and its user review", "information: {text}."),
    "wikics": ("graph", "an article on wikipedia about computer science", "information: {text}."),
    "instagram": ("graph", "a user from instagram", "information: {text}."),
    "cornell": ("graph", "a webpage from a university", "information: {text}."),
    "wisconsin": ("graph", "a webpage from a university", "information: {text}."),
    "washington": ("graph", "a webpage from a university", "information: {text}."),
    "texas": ("graph", "a webpage from a university", "information: {text}."),
    "reddit": ("graph", "a user on Reddit", "posts: {text}"),
    "citeseer": ("citation graph", "a paper", "information: Title: , Abstract: {text}."),
    "bookchild": ("graph", "a children's book", "information: {text}."),
    "sportsfit": ("graph", "a sports & fitness product", "information: {text}."),
}
#: Spacing that two data sets have after the graph mark, a comma of one, the space before one's last comma.
SPACED, COMMA, LOOSE = ("bookchild", "sportsfit"), ("pubmed",), ("history",)
#: Prompts of the other tasks.
DESCRIBE = "Please briefly describe the center node of <graph>."
CONNECT = "Given two node-centered subgraphs: <graph> and <graph>, we need to predict whether these two nodes connect with each other. Please tell me whether two center nodes in the subgraphs should connect to each other."


def pieces(dataset: str, classes: list[str] | None = None) -> list[str]:
    """The prompt's text, with {title}, {abstract} and {text} as pieces of their own."""
    kind, noun, given = WORDING[dataset]
    names = classes if classes is not None else LISTED.get(dataset, CLASSES.get(dataset))
    if names is None:
        raise ValueError(f"{dataset} needs its classes")
    head = f"Given a node-centered {kind}: <graph>,{' ' if dataset in SPACED else ''}each node represents {noun}.The 0th node is the central node, with the following "
    tail = "The graph consists of the center node, the neighbors of the center node, and the context-relevant nodes."
    ask = f"We need to classify the center node{',' if dataset in COMMA else ''} into {len(names)} classes: {', '.join(names)}{' ,' if dataset in LOOSE else ', '}please tell me which class the center node belongs to?"
    out, rest = [], head + given + tail + ask
    while rest:
        at = min((i for i in (rest.find(f"{{{c}}}") for c in ("title", "abstract", "text")) if i >= 0), default=-1)
        if at < 0:
            return [*out, rest]
        end = rest.index("}", at) + 1
        out, rest = [*out, rest[:at], rest[at:end]], rest[end:]
    return out


def render(dataset: str, columns: dict[str, Column], classes: list[str] | None = None) -> Column:
    """A node's prompt; null columns count as empty."""
    return F.concat(*(F.coalesce(columns[p[1:-1]], F.lit("")) if p in ("{title}", "{abstract}", "{text}") else F.lit(p) for p in pieces(dataset, classes)))


def assemble_text(raw: Column, title: Column, abstract: Column) -> Column:
    """The raw text, or title and abstract; blank is one space; a node that has none of them is an error."""
    made = F.when(title.isNotNull() | abstract.isNotNull(), F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\tAbstract: "), F.coalesce(abstract, F.lit(""))))
    text = F.coalesce(raw, made)
    return F.when(text.isNull(), F.raise_error(F.lit("a node has neither text nor title nor abstract"))).when(F.trim(text) == "", " ").otherwise(text)


def description(task: str, label: Column, title: Column, abstract: Column) -> Column:
    """What a node's description should say: nd names the title, nda title and abstract, whichever there are."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    head = F.concat(F.lit("This is a paper in "), label, F.lit(" domain"))
    if task == "nd":
        return F.when(t == "", head).otherwise(F.concat(head, F.lit(", it's about "), t, F.lit(".")))
    if task != "nda":
        raise ValueError(task)
    by_title, by_abstract = F.concat(F.lit(", its title is "), t), F.concat(F.lit(", its abstract is "), a)
    return F.when((t == "") & (a == ""), head).when(t == "", F.concat(head, by_abstract, F.lit("."))).when(a == "", F.concat(head, by_title, F.lit("."))).otherwise(F.concat(head, by_title, by_abstract, F.lit(".")))


def product_description(label: Column, text: Column) -> Column:
    head = F.concat(F.lit("This is an amazon product which can be categorized as "), label, F.lit("."))
    return F.when(F.coalesce(text, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" It can be described as "), text))


#: What nodes and edges of a data set stand for in prompts that give the text itself, and its classes there.
ARXIV = ["cs.NA(Numerical Analysis)", "cs.MM(Multimedia)", "cs.LO(Logic in Computer Science)", "cs.CY(Computers and Society)", "cs.CR(Cryptography and Security)", "cs.DC(Distributed, Parallel, and Cluster Computing)", "cs.HC(Human-Computer Interaction)", "cs.CE(Computational Engineering, Finance, and Science)", "cs.NI(Networking and Internet Architecture)", "cs.CC(Computational Complexity)", "cs.AI(Artificial Intelligence)", "cs.MA(Multiagent Systems)", "cs.GL(General Literature)", "cs.NE(Neural and Evolutionary Computing)", "cs.SC(Symbolic Computation)", "cs.AR(Hardware Architecture)", "cs.CV(Computer Vision and Pattern Recognition)", "cs.GR(Graphics)", "cs.ET(Emerging Technologies)", "cs.SY(Systems and Control)", "cs.CG(Computational Geometry)", "cs.OH(Other Computer Science)", "cs.PL(Programming Languages)", "cs.SE(Software Engineering)", "cs.LG(Machine Learning)", "cs.SD(Sound)", "cs.SI(Social and Information Networks)", "cs.RO(Robotics)", "cs.IT(Information Theory)", "cs.PF(Performance)", "cs.CL(Computational Complexity)", "cs.IR(Information Retrieval)", "cs.MS(Mathematical Software)", "cs.FL(Formal Languages and Automata Theory)", "cs.DS(Data Structures and Algorithms)", "cs.OS(Operating Systems)", "cs.GT(Computer Science and Game Theory)", "cs.DB(Databases)", "cs.DL(Digital Libraries)", "cs.DM(Discrete Mathematics)"]
CORA = ["Case_Based", "Genetic_Algorithms", "Neural_Networks", "Probabilistic_Methods", "Reinforcement_Learning", "Rule_Learning", "Theory"]
PRODUCTS = ["Home & Kitchen", "Health & Personal Care", "Beauty", "Sports & Outdoors", "Books", "Patio, Lawn & Garden", "Toys & Games", "CDs & Vinyl", "Cell Phones & Accessories", "Grocery & Gourmet Food", "Arts, Crafts & Sewing", "Clothing, Shoes & Jewelry", "Electronics", "Movies & TV", "Software", "Video Games", "Automotive", "Pet Supplies", "Office Products", "Industrial & Scientific", "Musical Instruments", "Tools & Home Improvement", "Magazine Subscriptions", "Baby Products", "label 25", "Appliances", "Kitchen & Dining", "Collectibles & Fine Art", "All Beauty", "Luxury Beauty", "Amazon Fashion", "Computers", "All Electronics", "Purchase Circles", "MP3 Players & Accessories", "Gift Cards", "Office & School Supplies", "Home Improvement", "Camera & Photo", "GPS & Navigation", "Digital Music", "Car Electronics", "Baby", "Kindle Store", "Buy a Kindle", "Furniture & D&#233;cor", "#508510"]
TEXT_WORDING = {
    "arxiv": ("papers and edges represent co-citations", ARXIV),
    "products": ("products sold in Amazon, and edges between products indicate they are purchased together", PRODUCTS),
    "pubmed": ("papers about Diabetes and edges represent co-citations", LISTED["pubmed"]),
    "cora": ("papers and edges represent co-citations", CORA),
}
TEXT_LENGTH = 2000


def class_pieces(dataset: str, with_text: bool = True) -> list[str]:
    """A prompt that asks for the class, around the node's text if it gives that: before it and after it."""
    about, classes = TEXT_WORDING[dataset]
    head = f"Given a node-centered graph: <graph>, where nodes represent {about}"
    ask = f". We need to classify the center node into {len(classes)} classes: {', '.join(classes)}, please tell me which class the center node belongs to?"
    return [head + ", the node feature of center node is ", ask + " Direct tell me the class name."] if with_text else [head + ask]


def class_prompt(dataset: str, text: Column | None = None) -> Column:
    """The human's turn for a node class, with the first TEXT_LENGTH characters of the text or without any; a null text is empty."""
    parts = [F.lit(p) for p in class_pieces(dataset, text is not None)]
    return parts[0] if text is None else F.concat(parts[0], F.substring(F.coalesce(text, F.lit("")), 1, TEXT_LENGTH), parts[1])


def task_prompt(task: str, own: Column) -> Column:
    """The human's turn of a task: a node class keeps its own prompt; for text alone there is class_prompt()."""
    return {"nc": own, "lp": F.lit(CONNECT), "nd": F.lit(DESCRIBE), "nda": F.lit(DESCRIBE)}[task]


def record(node_id: Column, graph: Column, human: Column, gpt: Column) -> Column:
    """One prompt record."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.struct(node_id.alias("id"), graph.alias("graph"), F.array(turn("human", human), turn("gpt", gpt)).alias("conversations"))
