"""Extensions over growing folders; the rest of the engine reads files that are complete."""
