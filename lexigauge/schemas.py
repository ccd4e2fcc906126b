"""Schemas at the boundary to models and to files."""

from __future__ import annotations

#: A ranking record: candidates of one item, the index of the right one, and grouping metadata.
ITEM = "item_id long, uid string, sentences array<string>, prefixes array<string>, completions array<string>, label int, meta map<string,string>"
#: A model's log-probability of each token of each candidate.
TOKEN_SCORE = "item_id long, cand_idx int, pos int, logprob double, in_phrase boolean"
CANDIDATE_SCORE = "item_id long, cand_idx int, score double, n_tokens int, n_chars int, has_unk boolean"
STEP_SURPRISAL = "word string, step double, context_id int, surprisal double, n_subword int, vocab_size int"
READING = "subid string, itemid string, sentnum int, wordnum int, word string, rt double, lang string"
EXPECTATION = "task string, uid string, expected_rows long"

MINIMAL_PAIR = "sentence_good string, sentence_bad string, field string, UID string, linguistics_term string"
CONTEXT_PAIR = "Context1 string, Context2 string, Target1 string, Target2 string, Domain string, ContextType string, ContextDiff string, TargetDiff string"
STATE_OPTIONS = "input_prefix string, options array<string>, numops int"
PROPERTY_PAIR = "prefix_acceptable string, prefix_unacceptable string, property_phrase string"
QUESTION = "question string, target_ans string, distractors array<string>, idx_in_hf_dataset int"
CAPTIONS = "caption_0 string, caption_1 string, collapsed_tag string, tag string, secondary_tag string, image_idx int, image_key string"
SOLUTIONS = "prompt string, solution0 string, solution1 string, solution2 string, solution3 string, label int, example_id string"
READING_CSV = "item string, word string, prev_item string, prev_word string, Subtlex_log10 double, length double, context_length double, prev_length double, RTfirstfix double, RTfirstpass double, RTgopast double, RTrightbound double, self_paced_reading_time double, ELAN double, LAN double, N400 double, P600 double, EPNP double, PNP double"
SAMPLE_LOG = "doc_id long, doc_hash string, filtered_resps array<array<string>>, target string, acc double"
