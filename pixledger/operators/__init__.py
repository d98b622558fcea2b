"""Operators: one public function per catalog operation, DataFrame to DataFrame."""
