"""Tables of scenes, prompts, vocabularies and videos."""
