"""The search engine has no streaming operator; stateful streams live with the operators that need them."""
