"""Built-in prompt sets (fixed values that must equal the reference's)."""

# Sample corpus catalog: language -> five prompts, in this order.
SAMPLE_PROMPTS = {
    "python": [
        "Implement a function to find the longest common subsequence between two strings",
        "Write a function to merge two sorted linked lists",
        "Create a decorator that measures function execution time",
        "Implement a binary search tree with insert, delete, and search operations",
        "Write a function to calculate the factorial of a number using memoization",
    ],
    "cpp": [
        "Implement a thread-safe singleton pattern in C++",
        "Write a template function to find the maximum element in a container",
        "Create a RAII wrapper for file handling",
        "Implement a custom smart pointer class",
        "Write a function to reverse a linked list iteratively",
    ],
    "rust": [
        "Implement a function to find all prime numbers up to n using Sieve of Eratosthenes",
        "Create a generic function to sort a vector in-place",
        "Write a function to parse a JSON string safely",
        "Implement a simple HTTP client using async/await",
        "Create a function to calculate the Fibonacci sequence using an iterator",
    ],
}

# Default evaluation prompts used when the prompt file is missing, in order.
DEFAULT_EVAL_PROMPTS = [
    {"prompt": "Implement a binary search function", "language": "python"},
    {"prompt": "Create a thread-safe queue", "language": "cpp"},
    {"prompt": "Write a function to parse JSON safely", "language": "rust"},
    {"prompt": "Implement a decorator that measures execution time", "language": "python"},
    {"prompt": "Create a RAII wrapper for file handling", "language": "cpp"},
]
