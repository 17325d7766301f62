"""Word lists, patterns and tables that results depend on."""

# fixed values: words dropped by the tokenizer
STOPWORDS = """
a an and are as at be by can for from how
design find generate idea ideas improve improving in
into is it its like method novel of on or
our please proposal task tasks that the their this
to testable use used using validation via we with within
without would
""".split()

# fixed values: one token
TOKEN_PATTERN = r"[a-z][a-z0-9_\-]{2,}"

# fixed values: white space as a text splitter sees it (tab to CR, FS to space, NEL, separators)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"

# fixed values: query expansion, triggers -> phrases, in dictionary order
QUERY_EXPANSIONS = [
    (["三维重建", "3d reconstruction"],
     ["3d reconstruction", "three dimensional reconstruction", "multi view stereo"]),
    (["稀疏数据", "稀疏视角", "有限视角", "少视角", "有限视图"],
     ["sparse view", "few view", "limited view", "sparse-view 3d reconstruction", "few-view 3d reconstruction"]),
    (["神经辐射场", "nerf"],
     ["neural radiance fields", "nerf"]),
    (["高斯", "gaussian"],
     ["3d gaussian splatting", "gaussian splatting"]),
    (["点云", "point cloud"],
     ["point cloud", "point cloud completion"]),
    (["timesfm", "时序", "时间序列", "序列特征"],
     ["time series foundation model", "time series representation learning", "time series forecasting", "TimesFM"]),
    (["传感器", "多传感器", "跨传感器", "sensor"],
     ["multisensor fusion", "cross sensor attention", "sensor transformer", "industrial sensor data"]),
    (["剩余使用寿命", "rul", "remaining useful life", "寿命预测"],
     ["remaining useful life prediction", "RUL prediction", "prognostics", "degradation modeling"]),
    (["mas", "multi-agent", "multi agent", "agent society", "agentic", "llm agent"],
     ["multi-agent systems", "LLM agents", "agent communication", "agent collaboration"]),
    (["scientific discovery", "science discovery", "research discovery", "科学发现"],
     ["AI for scientific discovery", "automated scientific discovery", "hypothesis generation",
      "scientific reasoning"]),
    (["symbolic compactness", "symbolic", "intrinsic reward", "intrinsic rewards", "compactness reward"],
     ["symbolic reasoning", "minimum description length", "program synthesis", "intrinsic motivation",
      "representation compression"]),
    (["machine dialect", "machine dialects", "dialect", "social interaction", "token cost", "completion cost"],
     ["agent communication protocol", "language model reasoning efficiency", "token efficient reasoning",
      "multi-agent debate", "emergent communication"]),
    (["few shot", "few-shot", "小样本", "少样本"],
     ["few-shot learning", "few-shot image classification", "few-shot transfer learning",
      "low-shot visual recognition"]),
    (["test time training", "test-time training", "test time adaptation", "test-time adaptation", "ttt",
      "测试时训练", "测试时适应"],
     ["test-time training", "test-time adaptation", "online adaptation", "transductive inference"]),
    (["clip", "视觉模型", "vision model", "vit", "vit^3", "cvpr2026", "4090"],
     ["CLIP", "vision-language model", "Vision Transformer", "parameter-efficient tuning", "prompt learning"]),
]
# fixed values: triggers that must stand alone as a word
WHOLE_WORD_TRIGGERS = ["rul"]

# fixed values: venue names looked for in free text, in order of precedence
VENUE_NAMES = """
NeurIPS ICML ICLR CVPR ICCV ECCV ACL EMNLP NAACL COLM KDD WWW SIGIR AAAI IJCAI Nature Science TMLR JMLR TPAMI
""".split()
# fixed values: venue ranking
TOP_VENUES = """
neurips icml iclr cvpr iccv eccv acl emnlp naacl colm kdd www sigir aaai ijcai jmlr tmlr tpami nature science
""".split()
AGGREGATORS = "arxiv openalex crossref".split()

# fixed values: concept type -> id prefix
CONCEPT_PREFIX = {
    "existed_idea": "XI",
    "principle": "P",
    "takeaway_message": "TM",
    "benchmark": "B",
    "baseline": "BL",
    "result_fact": "RF",
    "generated_idea": "I",
    "derived_concept": "D",
    "argument": "ARG",
    "hypothesis": "H",
    "deduction": "D",
    "failure_mode": "F",
    "assumption": "A",
    "user_note": "N",
}
DEFAULT_CONCEPT_PREFIX = "C"

# fixed values: concept type -> symbol prefix
SYMBOL_PREFIX = {
    "work": "W",
    "existed_idea": "XI",
    "principle": "P",
    "takeaway_message": "TM",
    "benchmark": "B",
    "baseline": "BL",
    "assumption": "A",
    "failure_mode": "F",
    "derived_concept": "D",
    "argument": "ARG",
    "hypothesis": "H",
    "deduction": "D",
    "generated_idea": "I",
}

# fixed values: payload fields read for a summary and for a label
SUMMARY_FIELDS = """
title name canonical_label idea_text message_text one_sentence_thesis abstract_signature mechanism summary
benchmark_name baseline_name dataset
""".split()
SUMMARY_LISTS = "mechanism_design why_it_might_work validation_protocol failure_modes domain_tags".split()
LABEL_FIELDS = "title name benchmark_name baseline_name dataset canonical_label".split()

# fixed values: principle fields merged by longest value and by ordered union
RICH_SCALARS = """
principle_type abstraction_level abstract_signature mechanism problem_pressure objective validation_level
""".split()
RICH_LISTS = """
scarce_resources assumptions constraints invariants tradeoffs failure_modes feedback_loop transfer_hooks
empirical_claims validation_notes domain_tags relation_hints compatible_principles contradiction_links
""".split()

# fixed values: document buckets and their concept type in the normalised store
BUCKET_CONCEPT_TYPE = {
    "existed_ideas": "existed_idea",
    "principles": "principle",
    "takeaway_messages": "takeaway_message",
    "benchmark_records": "benchmark",
    "baseline_records": "baseline",
    "result_records": "result_fact",
    "ideas": "generated_idea",
    "my_ideas": "generated_idea",
    "gap_cards": "failure_mode",
    "work_facts": "takeaway_message",
}
USER_BUCKETS = ["ideas", "my_ideas"]
# fixed values: every bucket, zero-filled in counts
BUCKETS = """
goals source_works principles principle_relations ideas estimates prompt_plans runs feedback field_profiles
project_memberships work_facts benchmark_records baseline_records result_records gap_cards frontier_snapshots
assistant_exports existed_ideas takeaway_messages my_ideas evidence_links research_runs
""".split()

# fixed values: derivation vocabulary
NODE_TYPES = """
evidence_card existed_idea principle takeaway_message benchmark baseline derived_concept argument hypothesis
deduction constraint failure_mode idea_seed final_idea
""".split()
DERIVED_NODE_TYPES = """
derived_concept argument hypothesis deduction constraint failure_mode idea_seed final_idea
""".split()
REPAIRED_NODE_TYPES = [t for t in DERIVED_NODE_TYPES if t != "final_idea"]
EDGE_TYPES = """
supports composes transfers_to abstracts specializes contradicts warns_against resolves_tradeoff assumes falsifies
validates leads_to derived_from
""".split()
OPERATORS = """
compose stress_test contrast specialize principle_transfer assumption_inversion contradiction_resolution
mechanism_composition failure_mode_transplant evaluator_binding
""".split()

# fixed values: price per million tokens by model name, first match wins
PRICE_TIERS = [
    (["gpt-5.5", "gpt-5.2-pro", "gpt-5-pro"], 120.0),
    (["deepseek-v4", "kimi-k2.6", "qwen3.5-122"], 16.0),
    (["deepseek", "qwen3-235", "72b", "glm-5"], 10.0),
    (["35b", "32b", "14b"], 3.0),
]
DEFAULT_PRICE = 1.2

# fixed values: search thresholds and weights
MIN_LEXICAL_LONG, MIN_LEXICAL_SHORT, LONG_QUERY_TERMS = 0.2, 0.08, 3
RELATED_IDEA_MIN = 0.18
RETENTION = {"source_works": 500, "principles": 1000, "ideas": 100}
FULL_TEXT_MIN_CHARS = 500
ACTIVE_STATUSES = ["queued", "running"]
